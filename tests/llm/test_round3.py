"""Spelling variants, license scans and whitening."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlore.llm import licenses, spelling, whitening
from gridlore.llm.queries import QUERIES, SQL
from tests.oracle import database, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_license_scan"])
def test_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    names, want = rows_of_sql(database(SF), SQL[name])
    assert sorted(df.columns) == names and want
    assert rows_of(df) == want


# spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé𝄞", max_size=6), min_size=1, max_size=40), st.text("abé𝄞", max_size=7))
def test_sorted_list_scan(words, query):
    listed = sorted(words)
    common = spelling.lcps(listed)
    for q in [query, *listed]:
        assert [listed[i] for i in spelling.near(listed, common, q)] == [w for w in listed if distance(w, q) == 1]


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(11)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(250)} | {"zzzzzz" + "".join(rng.choice("xy") for _ in range(rng.randrange(0, 6))) for _ in range(60)} | {"é" * 7, "é" * 8, "ÿ" * 7}
    return {w: rng.randrange(1, 900) for w in sorted(words)}


def brute(words):
    out = {}
    for w in words:
        close = [(-words[x], x) for x in words if abs(len(x) - len(w)) < 2 and distance(w, x) == 1]
        if close:
            out[w] = (len(close), -min(close)[0], min(close)[1])
    return out


@pytest.mark.parametrize("block", [3, 20, 20_000])
def test_near_words(spark, vocabulary, block):
    """Blocks of a few words are cut round by round, and shared out; nothing is lost or counted twice."""
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["near_n"], r["near_word"]) for r in spelling.near_words(df, block).collect()}
    assert got == brute(vocabulary)


def expected_variants(rows, damage):
    seen = Counter()
    for i, t in rows:
        for run in spelling.RUN.findall(t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            word = run if h % damage else run[:at] + run[at + 1 :]
            seen[word] += len(word) >= 6
    words = {w: n for w, n in seen.items() if n >= 5}
    close = brute(words)
    form = {w: c[2] for w, c in close.items() if c[1] >= 5 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, close.get(w, (0,))[0], words.get(form.get(w))))
    return out


@pytest.mark.parametrize("block", [2, 20_000])
def test_spelling_variants(spark, docs, corpus, block):
    rows = [(i, f"{t} Receivé receive RECEIVE recieve receive receive") for i, t in enumerate(["Ünïcode×÷ùù", ""] * 40)] + [(None, "receives receives recv " * 3), (7, "recei1ve received" * 2 + " receivess" * 30)] + corpus[-12:]
    rows += [(1000 + i, "planets " * 30 + "planetss " * 4 + "planetsss" * (i < 16)) for i in range(40)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, word string").repartition(4)
    got = [tuple(r) for r in spelling.spelling_variants(df, damage=3, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == expected_variants(rows, 3)
    assert any(r[1] for r in got) and any(r[2] != r[1] for r in got if r[1])
    assert spelling.spelling_variants(df.where("false")).count() == 0


def test_pieces_hold_whole_runs():
    text = "abc def," + "x" * 50 + " é" * 20
    for piece in (1, 3, 7):
        assert sum(spelling.runs_of(text, piece), Counter()) == Counter(spelling.RUN.findall(text))


# licenses


def test_markup():
    assert licenses.parse("A <<beginOptional>>b <<var;name=x;max=2>><<endOptional>>c") == [b"a", [b"b", 2], b"c"]
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<other>>"):
        with pytest.raises(ValueError, match="."):
            licenses.parse(bad)
    with pytest.raises(ValueError, match="mandatory"):
        licenses.Automaton.of({"x": "<<beginOptional>>a<<endOptional>>"})


def found(templates, text, piece=1 << 20):
    automaton = licenses.Automaton.of(templates)
    *places, n = licenses.matches(automaton, text.encode(), piece)
    return sorted((automaton.labels[t], at, m) for t, at, m in places), n


def test_regions():
    t = {"one": "permission <<beginOptional>>is <<beginOptional>>hereby <<endOptional>><<endOptional>>granted to <<var;name=who;max=2>> free", "two": "<<var;name=a;max=1>> of charge"}
    assert found(t, "Permission granted to free; PERMISSION is granted: to a b free") == ([("one", 0, 4), ("one", 4, 7)], 11)
    assert found(t, "permission hereby granted to free permission granted to a b c free permission is not granted to free") == ([], 18)
    assert found(t, "x of charge of charge") == ([("two", 0, 3), ("two", 1, 2), ("two", 2, 3), ("two", 3, 2)], 5)


@pytest.mark.parametrize("piece", [1, 5, 40])
def test_pieces_lose_no_place(piece):
    text = "Released under the MIT License. é" * 5 + " license " + "ü" * 90 + " licensed under CC BY 4.0"
    assert found(licenses.TEMPLATES, text, piece) == found(licenses.TEMPLATES, text)


def test_full_texts_are_found_and_changed_ones_are_not():
    filled = {n: licenses.MARKUP.sub(lambda m: " acme inc " if m.group(1).startswith("var") else " ", t) for n, t in licenses.TEMPLATES.items()}
    bare = {n: licenses.MARKUP.sub(" ", licenses.re.sub(r"<<beginOptional>>[^<]*<<endOptional>>", " ", licenses.re.sub(r"<<beginOptional>>[^<]*<<endOptional>>", " ", t))) for n, t in licenses.TEMPLATES.items()}
    for name in licenses.TEMPLATES:
        assert name in {p[0] for p in found(licenses.TEMPLATES, "so: " + filled[name] + " end")[0]}
        assert name in {p[0] for p in found(licenses.TEMPLATES, bare[name])[0]}
        words = [n for n in licenses.parse(licenses.TEMPLATES[name]) if isinstance(n, bytes)]
        broken = bare[name].lower().replace(words[-1].decode(), "other")
        assert name not in {p[0] for p in found(licenses.TEMPLATES, broken)[0]}


def test_scan(spark, docs, corpus):
    rows = [(1, "MIT License cc by CC BY-NC apache  license, gnu general public license mit license"), (1, None), (None, ""), (2, "licenseé mit licensé mıt license"), (3, "Released under the MIT License. " * 3), (4, "mit\x00license")]
    df = spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], "doc_id long, text string, n_words int, labels string")
    got = licenses.scan_licenses(df).drop("places").collect()
    assert tuple(got[0]) == (1, 15, 6, 0, 13, "apache,cc-by,gpl,mit", "apache,cc-by,gpl,mit", 4 / 12)
    assert tuple(got[1]) == (1, 0, 0, None, None, "", "", 0.0) and tuple(got[2])[1:] == (0, 0, None, None, "", "", 0.0)
    assert tuple(got[3]) == (2, 5, 0, None, None, "", "", 0.0)
    assert tuple(got[4])[1:7] == (15, 3, 3, 13, "mit", "mit,mit-notice") and tuple(got[5])[2] == 1
    assert licenses.scan_licenses(docs).count() == len(corpus) and licenses.scan_licenses(docs.where("false")).count() == 0


# whitening


def dense(vectors, scale=64):
    y = np.floor(np.array(vectors, float) * scale)
    c = y - y.mean(axis=0)
    v = c.T @ c / len(y)
    e, q = np.linalg.eigh(v)
    return y, c, e[::-1], q[:, ::-1], np.trace(v)


@pytest.mark.parametrize(("d", "n", "decay"), [(64, 400, 1.0), (150, 500, 0.93), (3, 40, 1.0), (50, 20, 1.0)])
def test_iteration(d, n, decay):
    rng = np.random.default_rng(d)
    _, c, e, q, _ = dense(rng.standard_normal((n, d)) * decay ** np.arange(d))
    calls = []
    values, base = whitening.jacobi_davidson(lambda p: (calls.append(1), c.T @ (c @ p) / n)[1], d, 32)
    k = min(32, d, n - 1)
    assert np.allclose(values[:k], e[:k], rtol=1e-12) and np.linalg.norm(c.T @ (c @ base) / n - base * values, axis=0).max() < 1e-12 * e[0]
    assert np.abs((base * q[:, : len(values)]).sum(axis=0))[:k].min() > 1 - 1e-9 and np.abs(base.T @ base - np.eye(len(values))).max() < 1e-12


def test_whitened(spark):
    rng = np.random.default_rng(3)
    whole = (rng.standard_normal((300, 9)) * np.arange(1, 10)).tolist()
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(whole)] + [(5, [0.25] * 9), (None, [1.0] * 9)]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 7), (902, [float("nan")] * 9), (903, [float("-inf")] * 9)]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows + bad], "vec_id long, embedding array<float>, n int, component string").repartition(3)
    got = whitening.whitened(df).collect()
    y, c, e, q, trace = dense([v for _, v in rows])
    assert len(got) == 302 * 9 and {r["component"] for r in got} == set(range(1, 10))
    by_dev = {int(d): w for d, w in zip((((len(y) * y - y.sum(axis=0)) ** 2).sum(axis=1)), c @ q / np.sqrt(e), strict=True)}
    table = {}
    for r in got:
        assert r["n"] == 302 and abs(r["explained"] / (e[r["component"] - 1] / trace) - 1) < 1e-10 and r["identity_error"] < 1e-10
        table.setdefault(r["deviation"], {})[r["component"]] = r["whitened"]
    assert set(table) == set(by_dev)
    have, want = np.array([[table[d][k] for k in range(1, 10)] for d in sorted(table)]), np.array([by_dev[d] for d in sorted(table)])
    assert np.abs(have * np.sign((have * want).sum(axis=0)) - want).max() < 1e-8


def test_whitening_edges(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).count() == make([(1, [1.0, 2.0])]).count() == make([(1, [1.0]), (2, [1.0])]).count() == make([(1, []), (2, [])]).count() == 0
    assert make([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]).select("component").distinct().count() == 1
    with pytest.raises(ValueError, match="entries"):
        make([(1, [1.0]), (2, [1.0, 2.0])])
    far = make([(i, [1e9 * (i % 7), float(i)]) for i in range(50)])
    assert far.where("deviation is null").count() > 0 and far.count() == 50
    with pytest.raises(Exception, match="too large"):
        make([(1, [1e30]), (2, [0.0])])

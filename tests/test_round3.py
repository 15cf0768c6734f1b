"""Row passages, profiles, vector search, budgets, stored tables, trigram postings, the status flow and Unicode texts."""

import json
import os
import random
import re
import statistics

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlore.functions import intents, texts
from gridlore.operators import archive, chunking, freshness, profile, retrieval, tables
from gridlore.operators.keyed import BUCKET, KeyedTable
from gridlore.operators.trigrams import TextIndex
from gridlore.shared import shared_path
from gridlore.streaming import flows

# row chunks


def packed(sizes, budget, used=0):
    part, out = 0, []
    for s in sizes:
        if used and used + s > budget:
            used, part = 0, part + 1
        used += s
        out.append(part)
    return out, used, part


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=50), st.lists(st.integers(0, 50), max_size=5), st.sampled_from([3, 20, 90]))
def test_passages(sizes, cuts, budget):
    """Passages of blocks, one after the other or composed, end where packing line by line ends, from any state."""
    at = sorted({0, len(sizes), *(c for c in cuts if c < len(sizes))})
    blocks = [chunking.Passage.of(np.array(sizes[a:b]), budget) for a, b in zip(at, at[1:], strict=False)]
    whole = blocks[0]
    for b in blocks[1:]:
        whole = whole.then(b, budget)
    for used in range(2 * budget):
        state, part = used, 0
        for b in blocks:
            state, more = b.through(state, budget)
            part += more
        assert (state, part) == whole.through(used, budget) == packed(sizes, budget, used)[1:]
    assert len(whole.ends) <= budget + 1


@pytest.mark.parametrize(("block_rows", "fan"), [(3, 2), (7, 3), (1000, 512)])
def test_row_chunks_in_blocks(spark, block_rows, fan):
    rng = random.Random(block_rows)
    rows = [(doc, sheet, i, "x" * rng.choice([0, 1, 5, 19, 20, 45])) for doc, sheet, n in (("a", "s", 60), ("a", "t", 1), ("b", "s", 33)) for i in range(2, n + 2)]
    df = spark.createDataFrame(rows + [(None, "s", 2, "y"), ("a", None, 2, "y")], "document_id string, sheet_name string, row_no bigint, line string").repartition(5)
    got = sorted((r["document_id"], r["sheet_name"], r["row_start"], r["row_end"], r["content"]) for r in chunking.chunk_rows_by_budget(df, 40, block_rows, fan).collect())
    want = []
    for key in (("a", "s"), ("a", "t"), ("b", "s")):
        own = [r for r in rows if r[:2] == key]
        parts = packed([len(r[3]) + 1 for r in own], 40)[0]
        for p in range(parts[-1] + 1):
            mine = [r for r, q in zip(own, parts, strict=True) if p == q]
            want.append((*key, mine[0][2], mine[-1][2], "\n".join(r[3] for r in mine)))
    assert got == sorted(want)
    assert chunking.chunk_rows_by_budget(df.where("false"), 40, block_rows, fan).count() == 0


# text chunks


def by_words(text, size):
    if len(text) <= size:
        return [text]
    out, words, used = [], [], 0
    for w in text.split(" "):
        if words and used + len(w) + 1 > size:
            out.append(" ".join(words))
            words, used = [], 0
        words.append(w)
        used += len(w) + 1
    return [*out, " ".join(words)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aé", min_size=1, max_size=12), min_size=1, max_size=40), st.integers(1, 30))
def test_words_packed(words, size):
    text = " ".join(words)
    assert chunking.pack_words(text, size) == by_words(text, size)


def test_text_chunks_over_pages(spark):
    rows = [(d, p, " ".join(f"w{i}" for i in range(n))) for d, p, n in (("a", 1, 9), ("a", 2, 0), ("a", 3, 30), ("a", 900, 4), ("b", 5, 12), ("b", None, 3))] + [(None, 1, "x y"), ("c", 1, None), ("c", 2, " \x1f \n")]
    df = spark.createDataFrame(rows, "document_id string, page int, content string").repartition(4)
    got = {(r["document_id"], r["chunk_index"]): (r["page"], r["content"]) for r in chunking.chunk_texts(df, 12).collect()}
    want = {}
    for d in ("a", "b"):
        i = 0
        for _, p, t in sorted((r for r in rows if r[0] == d), key=lambda r: -1 if r[1] is None else r[1]):
            for c in by_words(t, 12) if t else []:
                want[d, i] = (p, c)
                i += 1
    assert got == want
    small = chunking.page_offsets(spark.createDataFrame([("a", p, p) for p in range(1, 40)], "document_id string, page int, n int"), block_pages=4)
    assert {r["page"]: r["before"] for r in small.collect()} == {p: p * (p - 1) // 2 for p in range(2, 40)}


def test_numbers_carry_no_contents(spark):
    df = spark.createDataFrame([("d", i, f"t{i}") for i in range(50)] + [("e", 7, "u"), ("e", 7, "v")], "document_id string, pos bigint, content string")
    made = chunking.number_chunks(df.withColumn("pos", -F.col("pos")), ["pos"], block_chunks=8)
    got = {(r["document_id"], r["content"]): r["chunk_index"] for r in made.collect()}
    assert got == {("d", f"t{i}"): 49 - i for i in range(50)} | {("e", "u"): 0, ("e", "v"): 0}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert all("content" not in line for line in plan.splitlines() if "Window" in line)


# profiles


@pytest.mark.parametrize(("few", "splits"), [(1, 3), (4, 10), (None, 1000)])
def test_ranks(spark, few, splits):
    """Every rank of columns with ties, skew, huge and odd values, by passes of few splits."""
    rng = random.Random(splits)
    columns = {0: [rng.choice([1.0, 2.0, 1e300, -1e300, rng.random()]) for _ in range(301)], 1: [0.0] * 500 + [float(i) for i in range(40)], 2: [float("inf"), float("-inf"), float("nan"), float("nan"), 3.0], 3: [2.0**i for i in range(-500, 500)]}
    rows = [(c, v, n) for c, vs in columns.items() for v, n in {repr(v): (v, sum(repr(x) == repr(v) for x in vs)) for v in vs}.values()]
    df = spark.createDataFrame(rows, "c int, v double, n bigint").repartition(3)
    for share in (0, 0.3, 0.5, 1):
        ranks = {(c, int(share * (len(vs) - 1))): sum(r[0] == c for r in rows) for c, vs in columns.items()}
        got = profile.ranked(df, ranks, few, splits)
        for (c, at), v in got.items():
            assert np.array_equal(v, np.sort(columns[c])[at], equal_nan=True), (c, at)


def test_profile_of_odd_columns(spark):
    rows = [(None, 1.5, "a", True, "2024-01-02", "1.10", None), (3, -0.0, None, False, None, "2.5", None), (2**60, 0.0, "a", None, "1999-12-31", "10.00", None), (2**60 + 1, float("nan"), "b", True, "2024-01-02", None, None)]
    df = spark.createDataFrame(rows, "i bigint, d double, s string, b boolean, t string, m string, e int").select("i", "d", "s", "b", F.to_date("t").alias("t"), F.col("m").cast("decimal(10,2)").alias("m"), "e", F.col("i").cast("float").alias("_hidden"))
    got = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert set(got) == set("idsbtme")
    assert (got["i"]["row_count"], got["i"]["missing_count"], got["i"]["distinct_count"], got["i"]["min_value"], got["i"]["max_value"]) == (4, 1, 3, "3", str(2**60 + 1))
    assert got["d"]["distinct_count"] == 3 and got["d"]["max_value"] == "NaN" and got["d"]["min_value"] == "0.0"
    assert (got["t"]["min_value"], got["t"]["max_value"], got["t"]["distinct_count"]) == ("1999-12-31", "2024-01-02", 2)
    assert (got["m"]["min_value"], got["m"]["max_value"], got["m"]["median"], got["m"]["mean"]) == ("1.10", "10.00", 2.5, round((1.1 + 2.5 + 10) / 3, 4))
    assert got["m"]["std"] == round(statistics.stdev([1.1, 2.5, 10]), 4)
    assert (got["e"]["missing_count"], got["e"]["distinct_count"], got["e"]["min_value"], got["e"]["mean"]) == (4, 0, None, None)
    assert got["s"]["top_values"] == {"a": 2, "b": 1} and got["b"]["top_values"] == {"true": 2, "false": 1}
    empty = profile.profile(df.where("false")).collect()
    assert len(empty) == 7 and all(r["row_count"] == 0 and r["null_ratio"] == 0 for r in empty)


# vectors


def test_vector_search_with_ties(spark):
    """Many equal vectors, zeros, nulls and few vectors; batches and blocks of any size."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 5)).round(2)
    rows = [(i, base[i % 12].tolist()) for i in range(500)] + [(1000, [0.0] * 5), (1001, None), (1002, [1.0, None, 0.0, 0.0, 0.0])]
    asked = [(j, base[j].tolist()) for j in range(12)] + [(50, [0.0] * 5), (51, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame(asked, "question_id long, vector array<float>")
    for k, per_pass in ((3, 256), (60, 4), (600, 256)):
        got = {}
        for r in retrieval.semantic_search(v, q, k, per_pass=per_pass).collect():
            got.setdefault(r["question_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        unit = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, x in rows if x is not None and None not in x}
        assert set(got) == set(range(12)) | {50}
        for j, x in asked:
            if x is not None:
                own = np.array(x) / (np.linalg.norm(x) or 1)
                want = sorted(((-round(float(own @ u), 9), i) for i, u in unit.items()))[:k]
                assert [(i, s) for _, i, s in sorted(got[j])] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in want]
    assert retrieval.semantic_search(v.where("false"), q, 3).count() == retrieval.semantic_search(v, q.where("false"), 3).count() == 0
    with pytest.raises(Exception, match="entries"):
        retrieval.semantic_search(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>").coalesce(1), q, 3).collect()


def test_unit_rows():
    m, ok = retrieval.unit_rows(pa.array([[3.0, 4.0], None, [0.0, 0.0]], pa.list_(pa.float64())))
    assert ok.tolist() == [0, 2] and m.tolist() == [[0.6, 0.8], [0.0, 0.0]]


# budgets


def test_document_budget_in_blocks(spark):
    rng = random.Random(4)
    items = [(k, i, "x" * rng.choice([0, 3, 90, 400])) for k in ("a", "b", "c") for i in range(120)] + [("d", 5, ""), ("e", 1, None), ("f", 9, "y" * 5000)]
    df = spark.createDataFrame(items, "question_id string, pos int, text string").repartition(3)
    want = set()
    for k in "abcdef":
        used = 0
        for _, i, t in sorted(x for x in items if x[0] == k):
            if 1000 - used < retrieval.MIN_USEFUL:
                break
            want.add((k, i, t if t is None else t[: 1000 - used]))
            used += len(t or "")
    for block in (1, 7, 1024):
        got = {tuple(r) for r in retrieval.fit_documents(df, F.lit(1000), most=1000, block=block).collect()}
        assert got == want


def test_first_fit_of_many(spark):
    rng = random.Random(8)
    items = [(k, i, f"u{i}", "x" * rng.choice([0, 1, 2, 7, 30, 55, 200])) for k in range(4) for i in range(150)] + [(9, 1, "u", None), (10, 0, "v", "z" * 500)]
    df = spark.createDataFrame(items, "question_id int, pos int, url string, text string").repartition(3)
    want, total = set(), {}
    for k in (0, 1, 2, 3, 9, 10):
        used = 0
        for _, i, u, t in sorted(x for x in items if x[0] == k and x[3] is not None):
            t = t[:60]
            if used + len(t) <= 333:
                used += len(t)
                want.add((k, i, u, t))
        total[k] = used
    got = retrieval.fit_web(df, 333, web_chars=60).collect()
    assert {tuple(r)[:4] for r in got} == want and all(r["used"] == total[r["question_id"]] for r in got)


# stored tables


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merges_touch_only_their_buckets(spark):
    old = spark.createDataFrame([(f"k{i}", i, "old") for i in range(200)], "key string, n int, note string")
    t = KeyedTable(shared_path(spark, "t"), ("key",), 16).create(old)
    before = files_of(t.path)
    new = spark.createDataFrame([("k7", -1, "new"), ("k7", -2, "newer"), ("x", -3, "new"), (None, 0, "null")], "key string, n int, note string")
    touched = {r[0] for r in t._dealt(new).select(BUCKET).collect()}
    t.upsert(new.where("key is not null"), [F.asc("n")], keep=["note"])
    after = files_of(t.path)
    kept = {f for f in before if int(f.split(f"{BUCKET}=")[1].split("/")[0]) not in touched}
    assert kept and all(after.get(f) == before[f] for f in kept) and any(f not in after for f in before)
    rows = {r["key"]: (r["n"], r["note"]) for r in t.read(spark).collect()}
    assert len(rows) == 201 and rows["k7"] == (-2, "old") and rows["x"] == (-3, "new") and rows["k8"] == (8, "old")
    same = tables.upsert(old, new.where("key is not null"), ["key"], [F.asc("n")], ["note"])
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, t.read(spark).collect()))

    now = files_of(t.path)
    t.insert_if_absent(new.where("key = 'k7'"), [F.asc("n")])  # nothing is absent: nothing changes
    assert files_of(t.path) == now
    t.insert_if_absent(spark.createDataFrame([("k7", 5, "a"), ("y", 6, "b"), ("y", 7, "c")], old.schema), [F.asc("n")])
    assert set(now.items()) <= set(files_of(t.path).items()) and t.read(spark).where("key = 'y'").collect()[0]["n"] == 6
    assert sorted(r["key"] for r in t.looked_up(spark.createDataFrame([("y",), ("k1",), ("none",)], "key string")).collect()) == ["k1", "y"]
    t.replace(spark.createDataFrame([("y", 1, "p"), ("y", 2, "q")], old.schema), gone=spark.createDataFrame([(f"k{i}",) for i in range(200)], "key string"))
    assert sorted((r["key"], r["n"]) for r in t.read(spark).collect()) == [("x", -3), ("y", 1), ("y", 2)]
    none = KeyedTable(shared_path(spark, "t"), ("key",), 4).create(old.where("false"))
    assert none.read(spark).count() == 0
    none.upsert(old, [F.asc("n")])
    assert none.read(spark).count() == 200


# trigrams


def test_trigram_search(spark):
    rng = random.Random(6)
    words = ["token", "Straße", "naïve", "the", "and", "of", "licence", "x" * 30]
    rows = [(f"h{i}", f"http://a/{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))), i) for i in range(150)] + [("n", None, None, 1), ("e", "", "", 2), ("one", "http://rare/", "zebra crossing", 3)]
    df = spark.createDataFrame(rows, "url_hash string, url string, content string, timestamp long")
    index = archive.page_index(shared_path(spark, "i"), 8).build(df)
    for text in ("token", "TOKEN the", "straße", "zebra", "ebr", "ab", "", "tok%nce", "%", "no such text", "rare", "a/1", "naïve of"):
        found = archive.candidate_pages(spark, index, text)
        assert sorted(archive.search_pages(found, text, 500).collect()) == sorted(archive.search_pages(df, text, 500).collect()), text
        assert archive.count_pages(found, text).first()[0] == archive.count_pages(df, text).first()[0]
    narrow = archive.candidate_pages(spark, index, "zebra")
    bucket = index.holding(spark, "zebra").first()["bucket"]
    plan = narrow._jdf.queryExecution().sparkPlan().toString()
    assert narrow.count() == 1 and re.search(rf"PartitionFilters: \[[^\]]*__bucket#\d+ (?:= |IN \(){bucket}\b", plan), plan
    history = spark.createDataFrame([("zebra things", "h3"), ("other", "h4")], "query string, url_hash string")
    for q in ("zebra", "token ", "things"):
        assert sorted(archive.recall(archive.recall_candidates(spark, index, history, q), history, q, 500).collect()) == sorted(archive.recall(df, history, q, 500).collect())
    assert TextIndex(shared_path(spark, "i"), "url_hash", ("content",)).build(df.where("content = 'zebra crossing'")).candidates(spark, ["crossing", "nope"]).count() == 1


# status flow


def test_status_flow(spark, tmp_path):
    """A stream with broken files ends with error for them and ready for the rest; a batch that comes again changes nothing."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"good{i}.json").write_text("\n".join(json.dumps({"page": p, "content": f"page {p} of {i}", "n": p * 1.5}) for p in range(1, 4)))
    (folder / "broken.json").write_text('{"page": 1, "content": "a"}\n{"page": 2, "cont')
    (folder / "typed.json").write_text('{"page": "no number", "content": "a"}')
    (folder / "empty.json").write_text("\n \n")
    store = flows.Store(shared_path(spark, "store"), 4)
    chunked = lambda rows: chunking.chunk_texts(rows.select("document_id", "page", "content"))
    run = lambda: flows.file_stream(spark, str(folder), store, "json", "page int, content string, n double", str(tmp_path / "check"), chunked, files_per_batch=4).awaitTermination()
    run()
    shown = lambda: {r["path"].split("/")[-1]: (r["status"], r["row_count"], r["error"]) for r in store.table("documents").read(spark).collect()}
    first = shown()
    assert {k: v[0] for k, v in first.items()} == {"good0.json": "ready", "good1.json": "ready", "good2.json": "ready", "broken.json": "error", "typed.json": "error", "empty.json": "error"}
    assert first["broken.json"][2] == "1 of 2 records are broken" and first["empty.json"][2] == "no row could be read" and first["good0.json"][1] == 3
    all_rows = lambda: {n: sorted(map(str, store.table(n).read(spark).collect())) for n in ("documents", "rows", "chunks")}
    before = all_rows()
    assert len(before["rows"]) == len(before["chunks"]) == 9 and dict(store.table("rows").read(spark).dtypes)["n"] == "double"
    files = spark.read.format("binaryFile").load(str(folder)).select("path", "modificationTime")
    flows.ingest_files(files, store, "json", "page int, content string, n double", chunked)  # the same files again
    assert all_rows() == before
    (folder / "late.json").write_text(json.dumps({"page": 1, "content": "late"}))
    run()
    assert shown() == first | {"late.json": ("ready", 1, None)}


def test_broken_binary_files(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as int) as page", "'text' as content").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    (tmp_path / "in/broken.parquet").write_bytes(b"PAR1 nothing else PAR1")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(str(tmp_path / "in")).select("path", "modificationTime")
    store = flows.Store(shared_path(spark, "store"), 2)
    flows.ingest_files(files, store, "parquet", "page int, content string", lambda rows: chunking.chunk_texts(rows.select("document_id", "page", "content")))
    assert sorted((r["path"].endswith("broken.parquet"), r["status"], r["error"]) for r in store.table("documents").read(spark).collect()) == [(False, "ready", None), (True, "error", "no row could be read")]
    assert store.table("rows").read(spark).count() == 3


# texts


@pytest.mark.parametrize("text", ["a b\t", "\n a  b\x1f", "\x85A  b　\r\n", "a b", "​x﻿"])
def test_white_space_is_that_of_all_scripts(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(texts.normal_query(F.col("t")).alias("q"), texts.page_text(F.col("t")).alias("p")).first()
    assert r["q"] == text.strip().lower() and r["p"] == " ".join(text.split())


def test_cached_answer_of_a_query_with_a_tab(spark):
    answers = spark.createDataFrame([("what is it", "this", 1)], "query string, answer string, timestamp long")
    asked = spark.createDataFrame([(1, "What is it\t\n"), (2, " what is it"), (3, "what")], "question_id long, query string")
    assert {r["question_id"]: r["answer"] for r in archive.cached_answers(answers, asked).collect()} == {1: "this", 2: "this", 3: None}


@pytest.mark.parametrize(("query", "route"), [("ésum of it", "default_rag"), ("the sum of it", "aggregation_intent"), ("listé them", "default_rag"), ("customers with", "list_filter_intent"), (" \t", "empty_query"), ("from été", "list_filter_intent")])
def test_word_boundaries_are_those_of_all_scripts(spark, query, route):
    assert spark.createDataFrame([(query,)], "q string").select(intents.route(F.col("q")).alias("r")).first()["r"] == route


def test_digits_of_all_scripts(spark):
    rows = ["row ١٢", "row 34", "first ५ rows", "row 99999999999999999999"]
    got = [(r["a"], r["b"]) for r in spark.createDataFrame([(i, q) for i, q in enumerate(rows)], "i int, q string").orderBy("i").select(intents.row_intent(F.col("q"))["row_number"].alias("a"), intents.requested_rows(F.col("q")).alias("b")).collect()]
    assert got == [(12, None), (34, None), (None, 5), (None, None)]


def test_newest_text_time(spark):
    read = lambda *rows: freshness.newest_time(spark.createDataFrame([(r,) for r in rows], "t string"), "t").first()[0]
    assert str(read("2024-01-02 03:04:05", "2024-01-02T03:04:05", None)) == "2024-01-02 03:04:05"
    assert str(read("2024-01-02 03:04:05.250000", "2024-01-01T09:00:00")) == "2024-01-02 03:04:05.250000"
    assert read("2024-01-02 03:04:05", "yesterday") is None and read() is None and read(None) is None


def test_lookups(spark):
    t = spark.createDataFrame([("a", "s2", 1), ("a", "s1", 2), ("b", "s1", 3)], "document_id string, sheet_name string, row_count int")
    assert tables.default_sheet(t, "a").first()["row_count"] == 2 and tables.table_of(t, "b", "s1").first()["row_count"] == 3
    assert tables.table_of(t, "b", "s2").count() == tables.default_sheet(t, "c").count() == 0

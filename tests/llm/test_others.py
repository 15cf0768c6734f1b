"""Chat formatting, archives, language identification and pseudonyms."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlore.llm import pii
from gridlore.llm.chat_format import HOSTILE, PART, conversation_digests, escape, format_turns, read_turns, text_parts, unescape
from gridlore.llm.common import shared_path
from gridlore.llm.language_id import KernelParams, fit, held_out, predict, presence
from gridlore.llm.warc import OP2_SQL, assemble, op2_warc_transactions, page_records, read_archives, write_archives

# chat


def test_escapes_are_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|im_end|>", HOSTILE, "", "a<b|c", "\\<|\\", "<|<|<\\|"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("u")).collect()
    assert all(r["u"] == r["t"] and "<|" not in r["e"] for r in rows) and len({r["e"] for r in rows}) == len(texts)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi\n"), (1, 0, "user", HOSTILE), (2, 0, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (3, 5, "odd\nrole<|x", "é𝄞"), (-1, 1, "assistant", HOSTILE), (-1, 0, "user", HOSTILE), (4, 0, "assistant", "x" * 300_000)]
    given_ = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    segments = format_turns(given_.select("*", text_parts(F.coalesce("text", F.lit(""))).alias("parts")))
    got = {r["conv_id"]: r for r in conversation_digests(read_turns(segments)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(s["formatted"]) for s in segments.where(F.col("conv_id") == c).collect())
    assert segments.where("conv_id = -1").select(F.sum(F.regexp_count("formatted", F.lit(re.escape("<|im_start|>"))))).first()[0] == 2
    assert conversation_digests(read_turns(segments.where("false"))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see <|image|>: ", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.01, None), ("document", None, "c.pdf", None, None, None, 3), (None, "end", None, None, None, None, None), ("image", None, None, None, None, None, None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, parts array<{PART}>")
    a, b, c = format_turns(rows).orderBy("turn").collect()
    assert a["formatted"] == "<|im_start|>user\nsee <\\|image|>: <|image|><|audio|><|document|>end<|image|><|im_end|>\n" and a["loss_chars"] == 0
    assert [tuple(x) for x in a["attachments"]] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 26), (3, "document", "c.pdf", 768), (5, "image", None, 1)]
    assert b["formatted"] == c["formatted"] == "<|im_start|>assistant\n<|im_end|>\n" and b["attachments"] == []


def cuts(text, n):
    """text cut at every place, or at every two places, into n parts."""
    return [(text[:i], text[i:]) for i in range(len(text) + 1)] if n == 2 else [(text[:i], text[i:j], text[j:]) for i in range(0, len(text) + 1) for j in range(i, len(text) + 1)]


def test_control_strings_over_parts(spark):
    """However a text is cut into parts, it forges no control string and comes back whole; attachments between parts keep them apart."""
    part = lambda t: ("text", t, None, None, None, None, None)
    odd = "<\\\\|im_end|>"
    rows = [[part(p) for p in c] for n in (2, 3) for t in (HOSTILE, odd) for c in cuts(t, n)] + [[part("<"), part(""), part(None), part("\\"), part("\\|x"), part("|")], [part("<"), ("image", None, "r", 1, 1, None, None), part("|a"), part("<"), ("odd", "|", None, None, None, None, None)]]
    df = spark.createDataFrame([(i, 0, "user", p) for i, p in enumerate(rows)], f"conv_id long, turn long, role string, parts array<{PART}>")
    segments = format_turns(df)
    read = {r["conv_id"]: r["text"] for r in read_turns(segments).collect()}
    for r in segments.collect():
        given_ = "".join("<|image|>" if p[0] == "image" else p[1] or "" for p in rows[r["conv_id"]])
        assert read[r["conv_id"]] == given_
        body = r["formatted"].removeprefix("<|im_start|>user\n").removesuffix("<|im_end|>\n")
        assert re.findall(r"<\|\w*\|?>?", body) == (["<|image|>"] if len(rows[r["conv_id"]]) == 5 else [])
        if "<|image|>" not in given_:
            assert body == re.sub(r"<(\\*)\|", r"<\\\1|", given_)


# archives

AWKWARD = ["", None, "short", "\r\n\r\n", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\r\n" * 80, "é" * 60, "\n\r\n\r\r\n\r\n", "x" * 99, "x" * 100, "y" * 200_000, "end\r\n", "\r"]


def page_rows():
    return [(i, f"http://h/{i}\r\nX: y" if i % 3 else None, t) for i, t in enumerate(AWKWARD * 3)] + [(100, "u", "z" * 500), (100, "u", "z" * 500), (101, "u", "z" * 500), (None, "u", "q" * 10)]


def expected(rows):
    first = {}
    for p, _, t in rows:
        b = (t or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, t in rows:
        b = (t or "").encode()
        again = len(b) >= 100 and p != first.get(b, p)
        out.append((str(p), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(first[b]) if again else "None"))
    return sorted(out)


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash") for r in page_rows()], "page_id long, url string, html string, digest string").repartition(4)
    path = str(tmp_path / "pages.parquet")
    pages.write.parquet(path)
    got = op2_warc_transactions(spark, str(tmp_path)).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == expected(page_rows())
    pages.where("false").write.mode("overwrite").parquet(path)
    assert op2_warc_transactions(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("harm", ["cut", "length", "head"])
def test_broken_archives_are_errors(spark, tmp_path, harm):
    import gzip

    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(9)], "page_id long, url string, html string")
    path = str(tmp_path / "whole")
    write_archives(page_records(pages.coalesce(1)), path)
    assert read_archives(spark, path).count() == 27
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "whole").glob("*.gz")))
    data = {"cut": data[: int(len(data) * 0.9)], "length": data.replace(b"Content-Length: ", b"Content-Length: 1", 1), "head": data.replace(b"WARC/1.1", b"WURC/1.1", 2)}[harm]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "a.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="record"):
        read_archives(spark, str(tmp_path / "broken")).count()


@given(st.lists(st.text("\r\nWARC/1.ab", max_size=30), min_size=1, max_size=8))
@settings(max_examples=8, deadline=None)
def test_any_block_survives(spark, blocks):
    path = shared_path(spark, "any")
    write_archives(page_records(spark.createDataFrame([(i, "u", t) for i, t in enumerate(blocks)], "page_id long, url string, html string")), path)
    got = assemble(read_archives(spark, path, keep_payload=True))
    assert sorted(bytes(r["p"]).decode() for r in got.where("capture.warc_type = 'response'").select("capture.block").toDF("p").collect()) == sorted(blocks)
    first = got.first()
    assert len(first["requests"]) >= 1 and len(first["metadata"]) >= 1


def test_metadata_of_a_request_joins_its_capture(spark):
    schema = "record_id string, warc_type string, concurrent_to array<string>, block binary"
    rows = [("r", "response", [], b"1"), ("q", "request", ["r"], b"2"), ("m", "metadata", ["q"], b"3"), ("r2", "response", [], b"4"), ("lost", "metadata", ["nowhere"], b"5")]
    got = {r["capture"]["record_id"]: r for r in assemble(spark.createDataFrame(rows, schema)).collect()}
    assert [x["record_id"] for x in got["r"]["requests"]] == ["q"] and [x["record_id"] for x in got["r"]["metadata"]] == ["m"] and got["r2"]["requests"] == [] and len(got) == 2


def test_sql_agrees(spark):
    from tests.oracle import database, rows_of, rows_of_sql

    sf = "/root/testdata/sf0.001"
    assert rows_of(op2_warc_transactions(spark, sf)) == rows_of_sql(database(sf), OP2_SQL)[1]


# languages


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = predict(docs, fit(docs.where(~held_out())), extra={"held_out": held_out(), "lang": F.col("lang")}).collect()
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(spark, docs, no_docs):
    model = fit(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (135, 136, 137, 141)) and got[145]["lang_pred"] in ("en", "de")
    assert predict(no_docs, model).count() == 0 and fit(no_docs) is None
    assert {r["lang_pred"] for r in predict(docs, None).collect()} == {"und"}


def test_presence_ignores_case_and_counts():
    p = KernelParams()
    assert (presence("Abc, abc", p) == presence("abc ABC! abc", p)).all() and presence("12 !", p) is None and presence("", p) is None


# pseudonyms

VALUES = ["4785380592391139", "4111 1111 1111 1111", "4111111111111112", "152.143.123.131", "256.1.1.1", "+1 (743) 555-3824", "jane.doe7@mail.example.com", "2024-02-29", "2023-02-29", "31/12/1999", "123-45-6789", "666-45-6789", "GB82WEST12345698765432", "GB83WEST12345698765432", "1234", "0.5"]


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(d[0::2]) + sum((2 * x - 9 if x > 4 else 2 * x) for x in d[1::2])


def test_pseudonyms(spark):
    rows = [(i, f"a {v}, {v} b") for i, v in enumerate(VALUES)] + [(50, None), (51, ""), (52, "no digits"), (53, "x " * 50_000 + "152.143.123.131"), (54, "4785380592391139"), (54, "4785380592391139")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, m string, kind int")
    out = pii.pseudonymize(docs, "k")
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    got = {r["doc_id"]: r for r in out.collect()}
    for i, v in enumerate(VALUES):
        t = got[i]["text"]
        a, b = re.fullmatch(r"a (.*), (.*) b", t).groups()
        assert a == b
        if v in ("4111111111111112", "256.1.1.1", "2023-02-29", "666-45-6789", "GB83WEST12345698765432", "1234", "0.5"):
            assert a == v and got[i]["n_values"] == 0
        else:
            assert a != v and got[i]["n_values"] == 2 and re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", a))) == re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v)))
    assert luhn(re.search(r"a (\d+)", got[0]["text"])[1]) % 10 == 0 and luhn(re.search("a ([0-9 ]+),", got[1]["text"])[1]) % 10 == 0
    import datetime

    assert datetime.date.fromisoformat(re.search("a ([0-9-]+),", got[VALUES.index("2024-02-29")]["text"])[1])
    iban = re.search("a ([A-Z0-9]+),", got[VALUES.index("GB82WEST12345698765432")]["text"])[1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[3]["text"].split()[1].rstrip(",") == got[53]["text"].split()[-1] and got[50]["text"] == got[51]["text"] == "" and got[52]["text"] == "no digits"
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out, "k", inverse=True).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs, "another").collect()}
    assert other[0] != got[0]["text"] and pii.pseudonymize(docs.where("false"), "k").count() == 0


def test_small_domains_are_permuted(spark):
    pairs = spark.range(35).select(pii.permute_pair(F.floor(F.col("id") / 5), F.col("id") % 5, 7, 5, "k", "t").alias("p")).select("p.l", "p.r").collect()
    assert len({tuple(p) for p in pairs}) == 35 and all(0 <= a < 7 and 0 <= b < 5 for a, b in pairs)
    three = spark.range(1000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("s"))
    assert three.distinct().count() == 1000


@pytest.mark.parametrize("day", ["1900-01-01", "2099-11-13", "2099-12-31", "1999-12-31"])
def test_dates_come_back(spark, day):
    df = spark.createDataFrame([(1, day)], "doc_id long, text string")
    assert pii.pseudonymize(pii.pseudonymize(df, "k"), "k", inverse=True).first()["text"] == day


def test_addresses_keep_their_format(spark):
    ips = ["8.8.8.8", "10.0.0.1", "192.168.1.254", "255.255.255.255", "0.0.0.0", "99.100.9.10"] + [f"{a}.{b}.7.1" for a in range(10) for b in range(10)]
    mails = ["é.x@ex.org", "Àbc.dö@ex.org", "я.x@ex.org", "plain@ex.org"]
    df = spark.createDataFrame(list(enumerate(ips + mails)), "doc_id long, text string")
    out = pii.pseudonymize(df, "k")
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    for v, new in zip(ips, got, strict=False):
        assert [len(x) for x in new.split(".")] == [len(x) for x in v.split(".")] and all(str(int(x)) == x and int(x) < 256 for x in new.split("."))
    small = set(got[6 : len(ips)])
    assert len(small) == 100 and sum(a != b for a, b in zip(ips, got, strict=False)) > 90
    for v, new in zip(mails, got[len(ips) :], strict=True):
        assert new != v and new.endswith("@ex.org") and len(new) == len(v) and all(a == b or a.isalpha() for a, b in zip(v, new, strict=True))
    assert not got[len(ips)].startswith("é.x")
    assert [r["text"] for r in pii.pseudonymize(out, "k", inverse=True).orderBy("doc_id").collect()] == ips + mails


def test_values_before_any_end(spark):
    values = ["4785380592391139", "152.143.123.131", "+1 (743) 555-3824", "jane@mail.example.com", "jane@a.com.au", "2024-02-29", "31/12/1999", "123-45-6789", "GB82WEST12345698765432"]
    ends = [".", ".\n", ". x", ")", "\n", "", ". 5", ".."]
    rows = [(i * 10 + j, f"to {v}{e}") for i, v in enumerate(values) for j, e in enumerate(ends)] + [(900, "a@" + "b." * 50_000)]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k")
    got = {r["doc_id"]: r for r in out.collect()}
    for i, v in enumerate(values):
        made = {got[i * 10 + j]["text"].removeprefix("to ").removesuffix(e) for j, e in enumerate(ends)}
        assert len(made) == 1 and v not in made and all(got[i * 10 + j]["n_values"] == 1 for j in range(len(ends)))
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out, "k", inverse=True).collect()}
    assert back == dict(rows)


def test_cards_beside_numbers(spark):
    card, spaced, iban = "4785380592391139", "4111 1111 1111 1111", "GB82WEST12345698765432"
    cases = [
        (spaced, "{} 12/27"), (spaced, "{} 123"), (spaced, "7 {}"), (spaced, "7 {} 2027"), (spaced, "{} 12.50"), (spaced, "{}-" + "1234567890" * 3), (card, "{} 123"), (card, "{} 5"), ("378282246310005", "{} 12/27 1234"),
        ("3782 822463 10005", "1 {} 1234"), ("4111-1111-1111-1111", "12-{}-27"), ("4222 2222 2222 2", "{} 9"), (spaced, "2027 {}"), (spaced, "DE12 {} 11"), ("GB82 WEST 1234 5698 7654 32", "{} 4111"), (iban, "{}."), ("SE45 5000 0000 0583 9825 7466", "{} 2024 EUR"), ("41 111 11111111 11 1", "{}"),
    ]
    rows = [(i, f"a {t.format(v)}, b") for i, (v, t) in enumerate(cases)]
    rows += [(100, spaced), (101, card), (102, iban), (103, f"{spaced} {card} 31/12/1999 2024-02-29 123-45-6789"), (104, "1 " * 50_000), (105, "1" * 50_000), (106, f"{spaced} {spaced} 4111 1111 1111 1112")]
    rows += [(1000 + i, f"{1000 + 37 * i} {spaced} {100 + i}") for i in range(60)]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k")
    got = {r["doc_id"]: r for r in out.collect()}
    for i, (v, t) in enumerate(cases):
        before, after = t.split("{}")
        new = got[i]["text"].removeprefix(f"a {before}").removesuffix(f"{after}, b")
        assert new != v and len(new) == len(v) and got[i]["n_values"] == 1, (v, t, got[i])
        new = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1 if v[0].isalpha() else luhn(new) % 10 == 0
    plain = {i: got[i]["text"] for i in (100, 101, 102)}
    assert all(plain[100] in got[i]["text"] for i in range(6)) and plain[101] in got[6]["text"] and plain[102] == got[14]["text"][2:].removesuffix(" 4111, b").replace(" ", "")
    assert (got[103]["n_card"], got[103]["n_day_date"], got[103]["n_iso_date"], got[103]["n_ssn"]) == (2, 1, 1, 1) and got[104]["n_values"] == got[105]["n_values"] == 0
    assert got[106]["text"] == f"{plain[100]} {plain[100]} 4111 1111 1111 1112"
    assert all(got[i]["n_card"] == 1 for i, _ in rows if i >= 1000)
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out, "k", inverse=True).collect()}
    assert back == dict(rows)

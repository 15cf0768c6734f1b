"""Cells, names, chunks, keyed writes, series, retrieval, freshness and streams on small tables."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlore.functions import cells, intents, texts
from gridlore.operators import archive, chunking, freshness, retrieval, tables, timeseries
from gridlore.sources import html, ingest
from gridlore.streaming import flows


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["2020-01-15", "2021-06-30", "2022-12-01"], "date"), (["1", "2", "3", "4"], "integer"), (["1.1", "2.2", "3.3"], "float"), (["true", "False", "yes"], "boolean"), (["hello", "world"], "string"),
        ([None, " "], "string"), (["2020", "2021"], "integer"), (["1"] * 9 + ["x"], "integer"), (["1"] * 8 + ["x", "y"], "string"), (["2020-01-15"] * 8 + ["x", "y"], "date"), (["2020-01-15"] * 7 + ["x", "y", "z"], "string"), (["0", "1"], "boolean"),
    ],
)
def test_inference(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert cells.infer_types(df) == {"c": kind}


def test_inference_of_typed_columns(spark):
    df = spark.createDataFrame([(1.0, 2.5, True, dt.datetime(2020, 1, 1), 0)], "whole double, part double, yes boolean, at timestamp_ntz, n int")
    assert cells.infer_types(df) == {"whole": "integer", "part": "float", "yes": "boolean", "at": "date", "n": "integer"}


@pytest.mark.parametrize(("text", "kind", "want"), [("true", "boolean", True), ("false", "boolean", False), ("odd", "boolean", False), (None, "boolean", None), ("42", "integer", 42), ("42.9", "integer", 42), ("-42.9", "integer", -42), ("x", "integer", None), ("3.14", "float", 3.14), ("  hello  ", "string", "hello"), ("2020-06-15", "date", dt.datetime(2020, 6, 15)), ("nan", "integer", None), ("1e400", "integer", None)])
def test_cells(spark, text, kind, want):
    got = spark.createDataFrame([(text,)], "c string").select(cells.normalized(F.col("c"), kind).alias("v")).first()["v"]
    assert got == want


def test_dates_of_every_notation(spark):
    import datetime

    t = datetime.datetime
    cells_ = {"2020-01-02 03:04:05.678901": t(2020, 1, 2, 3, 4, 5, 678901), "2020-01-02 03:04:05": t(2020, 1, 2, 3, 4, 5), "2020-01-02T03:04:05": t(2020, 1, 2, 3, 4, 5), "2020-01-02T03:04:05.5": t(2020, 1, 2, 3, 4, 5, 500000), "2020-01-02": t(2020, 1, 2), "2020/01/02": t(2020, 1, 2), "01/02/2020": t(2020, 1, 2), " 2020-01-02\u00a0": t(2020, 1, 2), "2020": None, "5-LOW": None, "2020-13-01": None, "20-01-02": None, "": None, "1/2/2020x": None}
    rows = spark.createDataFrame([(c,) for c in cells_], "c string").select("c", cells.read_date(F.col("c")).alias("d")).collect()
    slow = spark.createDataFrame([(c,) for c in cells_], "c string").select("c", F.coalesce(*[F.try_to_timestamp(cells.stripped(F.col("c")), F.lit(f)) for f in cells.DATE_FORMATS]).alias("d"))
    assert {r["c"]: r["d"] for r in rows} == cells_ and all(r["d"] == cells_[r["c"]] for r in slow.collect() if r["c"] != "2020")


def test_safe_names():
    assert list(cells.safe_names(["a", "A", "a!", "a_2"]).values()) == ["col_a", "col_a_2", "col_a_3", "col_a_2_2"]
    assert len(set(cells.safe_names([f"x{'!' * k}" for k in range(3000)]).values())) == 3000
    assert cells.safe_names(["Total Revenue", "total-revenue", "__", "", "2020"]) == {"Total Revenue": "col_total_revenue", "total-revenue": "col_total_revenue_2", "__": "col_col", "": "col_col_2", "2020": "col_2020"}


def test_cell_texts(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("v")).first()["v"]
    assert one(cells.cell_text(F.lit(1275004800), "date")) == "2010-05-28"
    assert one(cells.cell_text(F.lit(9925), "integer")) == "9,925"
    assert one(cells.cell_text(F.lit(1234.5), "float")) == "1,234.5" and one(cells.cell_text(F.lit(1000.0), "float")) == "1,000" and one(cells.cell_text(F.lit(0.12345), "float")) == "0.1235"
    assert one(cells.cell_text(F.lit(1275004800), "untyped_integer", "Order Date")) == "2010-05-28" and one(cells.cell_text(F.lit(12), "untyped_integer", "n")) == "12"
    assert one(cells.cell_text(F.lit(1234.5678), "untyped_float")) == "1,235" and one(cells.cell_text(F.lit(0.00123456), "untyped_float")) == "0.001235"
    assert one(cells.cell_text(F.lit(None).cast("int"), "integer")) == ""


def test_ingest_numbers_rows_in_file_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Order Id,Amount,When\n" + "".join(f"{i},{i}.5,2020-01-{i % 28 + 1:02d}\n" + (",,\n" if i % 10 == 0 else "") for i in range(200)))
    got = ingest.ingest(ingest.read_raw(spark, str(tmp_path / "t.csv"), "csv"))
    assert [f.metadata.get("logical_type") for f in got.schema.fields[1:]] == ["integer", "float", "date"]
    assert [(r[0], r[1]) for r in got.orderBy("_source_row_number").collect()] == [(i + 1, i) for i in range(200)]


def test_row_numbers_over_partitions(spark, tmp_path):
    spark.range(1000).repartition(7).sortWithinPartitions("id").write.parquet(str(tmp_path / "r"))
    got = tables.row_numbers(spark.read.parquet(str(tmp_path / "r")))
    assert sorted(r[0] for r in got.collect()) == list(range(1, 1001))


def _loop(words, size):
    out, cur, n = [], [], 0
    for w in words:
        if n + len(w) + 1 > size and cur:
            out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(w)
        n += len(w) + 1
    return out + ([" ".join(cur)] if cur else [])


@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=60), st.integers(5, 60))
@settings(max_examples=200, deadline=None)
def test_packed_words(words, size):
    text = " ".join(words)
    got = chunking.pack_words(text, size)
    assert got == ([text] if len(text) <= size else _loop(words, size)) and " ".join(got) == text


def test_chunks_give_back_the_page(spark):
    pages = spark.createDataFrame([("d", 1, " a  b\n" * 3000), ("d", 2, "   "), ("d", 3, "x" * 5000), ("e", 1, None)], "document_id string, page int, content string")
    rows = chunking.chunk_texts(pages).orderBy("document_id", "chunk_index").collect()
    assert " ".join(r["content"] for r in rows if r["page"] == 1) == " ".join(["a b"] * 3000) and [r["chunk_index"] for r in rows] == list(range(len(rows))) and {r["page"] for r in rows} == {1, 3}


def test_row_chunks(spark):
    lines = spark.createDataFrame([("d", "s", i, f"Row {i}: " + "v" * 40) for i in range(2, 202)], "document_id string, sheet_name string, row_no long, line string")
    rows = chunking.chunk_rows_by_budget(lines, 500).orderBy("chunk_index").collect()
    assert "\n".join(r["content"] for r in rows) == "\n".join(r["line"] for r in lines.orderBy("row_no").collect())
    assert all(len(r["content"]) < 500 for r in rows) and rows[0]["row_start"] == 2 and rows[-1]["row_end"] == 201
    two = lines.unionByName(lines.where("row_no < 50").withColumn("sheet_name", F.lit("a"))).repartition(7)
    again = chunking.chunk_rows_by_budget(two, 500).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in again] == list(range(len(again))) and [r["content"] for r in again if r["sheet_name"] == "s"] == [r["content"] for r in rows] and again[0]["sheet_name"] == "a"


def test_first_write_wins_or_last(spark):
    old = archive.page_rows(spark.createDataFrame([("u", "old", 1)], "url string, content string, timestamp int"))
    new = spark.createDataFrame([("u", "new", 2), ("v", "b", 3), ("v", "a", 2)], "url string, content string, timestamp int")
    assert {(r["url"], r["content"]) for r in archive.save_pages(old, new).collect()} == {("u", "old"), ("v", "a")}
    assert {(r["url"], r["content"]) for r in archive.save_pages(old, new, keep="last").collect()} == {("u", "new"), ("v", "b")}


def test_partition_replaced_on_disk(spark, tmp_path):
    path = str(tmp_path / "reg")
    spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, x int").write.partitionBy("document_id").parquet(path)
    tables.replace_partition(spark.createDataFrame([("b", 3)], "document_id string, x int"), path, ["document_id"])
    assert {(r["document_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


@pytest.fixture(scope="module")
def library(spark):
    documents = spark.createDataFrame([("id-1", "doc-1.pdf", "ready"), ("id-2", "doc-2.pdf", "ready"), ("id-3", "doc-3.pdf", "pending")], "document_id string, filename string, status string")
    rows = [("id-1", 0, "alpha match from document one"), ("id-1", 1, "alpha second line from document one"), ("id-2", 0, "alpha match from document two"), ("id-2", 1, "beta only line from document two"), ("id-3", 0, "alpha hidden"),
            ("id-2", 2, "Row 7: Index=1, Name=x\nRow 8: Index=10, Name=y")]
    meta = "named_struct('page', chunk_index + 1, 'sheet', cast(null as string), 'row_start', cast(null as bigint), 'row_end', cast(null as bigint))"
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, content string").withColumn("chunk_id", F.concat_ws(":", "document_id", F.col("chunk_index").cast("string"))).withColumn("meta", F.expr(meta))
    return chunks, documents


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_scope_never_widens(library):
    chunks, documents = library
    assert set(ids(retrieval.keyword_search(chunks, documents, "alpha", ids=["id-1"]))) == {"id-1:0", "id-1:1"}
    assert set(ids(retrieval.keyword_search(chunks, documents, "alpha"))) == set(ids(retrieval.keyword_search(chunks, documents, "alpha", ids=[]))) == {"id-1:0", "id-1:1", "id-2:0"}
    assert ids(retrieval.keyword_search(chunks, documents, "alpha", ids=["nope"])) == []


def test_hybrid(spark, library):
    chunks, documents = library
    q = spark.createDataFrame([(1, "what is in row 7"), (2, "who has 1 in the Index column"), (3, "beta"), (4, "last of doc-2.pdf file from doc-2.pdf"), (5, "zzz")], "question_id long, query string")
    rows = retrieval.hybrid_search(chunks, documents, q).orderBy("question_id", "pos").collect()
    by = {k: [r["text"] for r in rows if r["question_id"] == k] for k in range(1, 6)}
    assert by[1] == ["[doc-2.pdf] Page 3\nRow 7: Index=1, Name=x"]
    assert by[2] == ["[doc-2.pdf] Page 3\nRow 7: Index=1, Name=x\nRow 8: Index=10, Name=y"]
    assert by[3] == ["[doc-2.pdf] Page 2\nbeta only line from document two"]
    assert by[4] == ["[doc-2.pdf] Page 3\nRow 8: Index=10, Name=y"]
    assert by[5] == []
    parts = retrieval.hybrid_search(chunks, documents, q, per_pass=2)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, rows))


def _budget(web, docs, total, share, cut):
    wb, out, used = int(total * share), [], 0
    for t in web:
        t = t[:cut]
        if used + len(t) <= wb:
            out.append(t)
            used += len(t)
    left = total - used
    for t in docs:
        if left < 200:
            break
        out.append(t[:left])
        left -= len(t[:left])
    return out


def test_budget(spark):
    rng = np.random.default_rng(1)
    web, docs, want = [], [], {}
    for q in range(30):
        w, d = (["x" * int(n) for n in rng.integers(1, 900, 8)] for _ in range(2))
        web += [(q, i, f"u{i}", t) for i, t in enumerate(w)]
        docs += [(q, i, f"d{i}", t) for i, t in enumerate(d)]
        want[q] = _budget(w, d, 2500, 0.4, 600)
    schema = "question_id long, pos int, url string, text string"
    got = retrieval.allocate_budget(spark.createDataFrame(web, schema), spark.createDataFrame(docs, schema), 2500, 0.4, 600)
    rows = got.orderBy("question_id", "source", "pos").collect()
    assert {q: [r["text"] for r in rows if r["question_id"] == q] for q in want} == want


def test_semantic_search(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")
    q = vectors.where("vec_id < 5").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = retrieval.semantic_search(vectors, q, 4, F.col("label") == 1, per_pass=2).orderBy("question_id", "rank").collect()
    for k in range(5):
        allowed = [i for i in range(60) if i % 3 == 1]
        assert [r["vec_id"] for r in got if r["question_id"] == k] == sorted(allowed, key=lambda i: -u[i] @ u[k])[:4]


def test_forecast_bands(spark):
    rows = [("flat", i, 5.0) for i in range(4)] + [("up", i, float(i) + (i % 2)) for i in range(10)] + [("one", 0, 1.0)] + [("gap", i, None if i == 3 else float(i)) for i in range(10)] + [("bad", i, None if i < 4 else 1.0) for i in range(10)]
    got = {r["k"]: r for r in timeseries.forecast(spark.createDataFrame(rows, "k string, t int, value double"), ["k"], ["t"]).collect()}
    assert set(got) == {"flat", "up", "gap"} and got["flat"]["point"] == [5.0] * 3 and got["flat"]["lower"] == [5.0] * 3
    y = np.array([i + (i % 2) for i in range(10)], float)
    a, b = np.polyfit(np.arange(10), y, 1)
    std = np.std(y - (a * np.arange(10) + b))
    assert np.allclose(got["up"]["point"], [a * (10 + h) + b for h in range(3)], atol=1e-3) and np.allclose(got["up"]["upper"], [a * (10 + h) + b + 1.96 * std for h in range(3)], atol=1e-3)
    assert got["gap"]["policy"] == "forward_fill" and got["gap"]["n"] == 10


@pytest.mark.parametrize("kind", ["int", "double", "decimal(12,2)", "date", "timestamp", "timestamp_ntz", "string", "boolean"])
def test_series_in_blocks(spark, kind):
    rng = np.random.default_rng(5)
    rows = []
    for key in ("a", "b", None):
        for i in rng.permutation(400):
            n = int(i) * 3671 - 300_000
            t = {"int": n, "double": n / 7, "decimal(12,2)": n // 5, "date": dt.date(2000, 1, 1) + dt.timedelta(int(i) * 9), "string": f"{int(i) * 7:08d}"}.get(kind, dt.datetime(1999, 12, 25) + dt.timedelta(hours=int(i) * 31))
            rows.append((key, None if i == 399 else bool(i > 150) if kind == "boolean" else t, int(i), None if i < 5 or rng.random() < 0.4 else float(i)))
    if kind == "double":
        rows += [("a", float("nan"), 398, None), ("b", float("inf"), 398, 1.5)]
    source = {"boolean": "boolean", "decimal(12,2)": "int"}.get(kind, kind)
    df = spark.createDataFrame(rows, f"k string, t {source}, tie int, value double").withColumn("t", F.col("t").cast(kind)).repartition(7)
    rank = lambda r: (r["t"] is None, (r["t"] != r["t"], 0 if r["t"] != r["t"] else r["t"]) if r["t"] is not None else 0, r["tie"])
    want = {}
    for key in ("a", "b", None):
        series = sorted((r for r in df.collect() if r["k"] == key), key=rank)
        last = next(r["value"] for r in series if r["value"] is not None)
        for i, r in enumerate(series):
            last = last if r["value"] is None else r["value"]
            want[key, r["tie"], str(r["t"])] = (i, last)
    got = timeseries.filled(timeseries.indexed(df, ["k"], ["t", "tie"]), ["k"], ["t", "tie"]).collect()
    assert len(got) == len(rows) and {(r["k"], r["tie"], str(r["t"])): (r["i"], r["value"]) for r in got} == want
    assert timeseries.filled(df.where("false"), ["k"], ["t"]).count() == 0


def test_numbers_over_blocks(spark):
    rows = [(s, n) for s in ("x", "y", None) for n in range(2, 700, 3)]
    lines = spark.createDataFrame([("d", s, n, f"Row {n}") for s, n in rows], "document_id string, sheet_name string, row_no long, line string")
    got = chunking.chunk_rows_fixed(lines, 1, 16).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(rows)))
    assert [(r["sheet_name"], r["row_start"]) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))


@pytest.mark.parametrize(("share", "want"), [(0.0, "forward_fill"), (0.1, "forward_fill"), (0.2, "forward_fill_warned"), (0.3, "forward_fill_warned"), (0.31, "ineligible")])
def test_missing_policy(spark, share, want):
    assert spark.range(1).select(timeseries.missing_policy(F.lit(share)).alias("p")).first()["p"] == want


def test_sheet_record_reasons(spark):
    assert timeseries.sheet_record(spark.createDataFrame([(1,)], "n int")).first()["reason"] == "no_time_column"
    late = spark.createDataFrame([(None, 1), (None, 2), (dt.datetime(2020, 1, 1), 3)], "t timestamp_ntz, n int")
    assert timeseries.sheet_record(late).first()["reason"] == "time_column_high_missing"
    none = spark.createDataFrame([(dt.datetime(2020, 1, 1), "x")], "t timestamp_ntz, s string")
    assert timeseries.sheet_record(none).first()["reason"] == "no_eligible_measure"


@pytest.mark.parametrize(("minutes", "want"), [(59, "fresh"), (60, "fresh"), (61, "stale"), (-5, "fresh"), (None, "unknown")])
def test_freshness(spark, minutes, want):
    now = dt.datetime(2024, 1, 1, 12)
    at = None if minutes is None else now - dt.timedelta(minutes=minutes)
    rows = spark.createDataFrame([("s", "file", 60, "d", at, None)], "name string, type string, ttl_minutes int, description string, last_modified timestamp_ntz, fetch_error string")
    d = freshness.details(rows, F.lit(str(now)).cast("timestamp_ntz")).first()
    assert d["status"] == want and (minutes != -5 or (d["age_seconds"] == 0 and "clock" in d["error_message"]))


@pytest.mark.parametrize(
    ("query", "rows"),
    [("List first 10 rows of 100 Sales Record file ?", 10), ("show top 5 customers", 5), ("list 20 rows", 20), ("select all limit 7", 7), ("open 100 Sales Record file", None), ("top 900", 500), ("", None)],
)
def test_requested_rows(spark, query, rows):
    assert spark.createDataFrame([(query,)], "q string").select(intents.requested_rows(F.col("q")).alias("n")).first()["n"] == rows


def test_terms(spark):
    got = spark.createDataFrame([("What is the TOTAL revenue of it",), ("is it",), (" ".join(f"word{i}" for i in range(20)),)], "q string").select(texts.query_terms(F.col("q")).alias("t")).collect()
    assert [r["t"] for r in got] == [["total", "revenue"], ["is it"], [f"word{i}" for i in range(10)]]


def test_html():
    page = "<html><head><meta name='description' content=' d '><meta property='og:description' content='best'><script>var t='</p>';</script></head><body><nav>menu</nav><p>one  two</p><p>three</p><footer>f</footer></body></html>"
    assert html.clean_text(page) == "best\none\ntwo three" and html.clean_text(None) is None and html.clean_text("<p>open<nav>x") == "open"


def test_streams_equal_batch(spark, tmp_path):
    pages = spark.createDataFrame([(f"d{i}", 1, "word " * (i * 150)) for i in range(6)], "document_id string, page int, content string")
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    schema = "document_id string, page int, content string"
    pages.where("document_id < 'd3'").write.parquet(src)
    flows.ingest_stream(spark, src, schema, out, check).awaitTermination()
    pages.where("document_id >= 'd2'").write.mode("append").parquet(src)
    flows.ingest_stream(spark, src, schema, out, check).awaitTermination()
    cols = ["chunk_id", "document_id", "chunk_index", "content"]
    assert sorted(map(tuple, flows.read_chunks(spark, out).select(cols).collect())) == sorted(map(tuple, chunking.chunk_texts(pages).select(cols).collect()))


def test_context_digests_hold_no_context(spark, tmp_path):
    import duckdb

    import gridlore.plans.all as plans

    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "en", f"text {i}\nü" * (i % 40 + 1)) for i in range(3000)]
    rows += [(3000, None, "en", "a"), (3001, None, None, "b"), (3002, "none", "de", None), (3003, "some", "de", None), (3004, "some", "de", ""), (3005, "some", "de", "c"), (None, "some", "de", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").repartition(7)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = plans.QUERIES["f14_context_texts"](spark, str(tmp_path))
    assert "collect_list" not in df._jdf.queryExecution().executedPlan().toString()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {(r["source"], r["lang"]): r["context_md5"] for r in df.collect()}
    assert got == {(s, lang): m for s, lang, m in db.execute(plans.SQL["f14_context_texts"]).fetchall()}
    items = docs.groupBy("source", "lang").agg(F.collect_list(F.struct("doc_id", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), "text")).alias("x"))
    assert {(r[0], r[1]): r[2] for r in items.where("source <> 'none'").select("source", "lang", F.md5(texts.context_text(F.col("x")))).collect()} == {k: v for k, v in got.items() if k[0] not in (None, "none")}
    assert df.where("false").count() == 0 and retrieval.context_digests(docs.where("false").select("source", "lang", F.lit(1).alias("pos"), F.lit("u").alias("url"), "text"), ["source", "lang"]).count() == 0

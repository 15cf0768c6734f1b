"""Tests for the findings of round 3's review."""

import datetime as dt
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import gridlore.plans.all as plans
from gridlore.functions import cells
from gridlore.operators import chunking, retrieval, timeseries, trigrams
from gridlore.operators.keyed import BUCKET, KeyedTable
from gridlore.operators.trigrams import TextIndex
from gridlore.shared import BATCH_BYTES, shared_path
from gridlore.sources import ingest

from .oracle import rows_of, rows_of_sql


def lists_of(rows, texts):
    """(gram, row) pairs of what postings_of gives."""
    out = []
    for base, grams, counts, gaps in trigrams.postings_of(np.array(rows), texts):
        ends = np.cumsum(counts)
        for gram, n, end in zip(grams, counts, ends, strict=True):
            packed, sizes = trigrams.packed_gaps(gaps[end - n : end])
            assert len(packed) == sizes.sum() <= 2 * n
            out += [("".join(map(chr, gram)), base + int(r)) for r in trigrams.places_of(packed.tobytes())]
    return out


# postings name rows by a byte or two, not by keys


def test_postings():
    rng = random.Random(1)
    words = ["token", "Straße", "naïve", "\U0001f600\U0001f601x", "", "ab", "the the"]
    for n in (1, 2, 50):
        a = [None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(n)]
        b = [rng.choice(words) for _ in range(n)]
        rows = sorted(rng.sample(range(1 << 34, (1 << 34) + 16_000), n))
        got = lists_of(rows, [pa.array(a, pa.string()), pa.array(b, pa.string())])
        want = {(g, r) for r, *texts in zip(rows, a, b, strict=True) for t in texts for g in trigrams.grams_of(t or "") if len(g) == 3}
        assert len(got) == len(want) and set(got) == want


def test_postings_of_many_letters():
    """Alphabets too large for one number are taken in halves."""
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = [rng.sample(letters, 3_000) for _ in range(64)] + [letters]
    texts = ["".join(r) for r in rows]
    got = lists_of(range(len(texts)), [pa.array(texts, pa.string())])
    want = {(t[i : i + 3], r) for r, t in enumerate(texts) for i in range(len(t) - 2)}
    assert len(got) == len(want) and set(got) == want


def test_postings_are_small(spark, tmp_path):
    """Stored postings take less than the texts, keys of any length included."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    rows = [(f"{i:064d}", " ".join(rng.choice(words) for _ in range(40))) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k string, t string").repartition(3)
    index = TextIndex(str(tmp_path / "i"), "k", ("t",), 2).build(df)
    stored = spark.read.parquet(f"{index.path}/postings")
    assert {f.name for f in stored.schema} == {"gram", "bucket", "base", "n", "gaps", "__part"}
    assert stored.agg(F.sum("n")).first()[0] == sum(len(trigrams.grams_of(t)) for _, t in rows)
    size = lambda d: sum(f.stat().st_size for f in (tmp_path / "i" / d).rglob("*.parquet"))
    assert size("postings") < sum(len(t) for _, t in rows)
    want = {k for k, t in rows if words[0] + " " + words[1] in t or words[2] in t}
    found = index.candidates(spark, [words[0] + " " + words[1], words[2]])
    assert want <= {r["k"] for r in found.collect()} and found.count() == found.select("k").distinct().count() < 3_000


# a whole number in a column named like a date is a day only within 2000 to 2100; the query shows numbers that are none


def test_untyped_numbers_of_large_keys(spark, tmp_path):
    rows = [(k, k % 7, "F", p, dt.datetime(1995 + k % 9, 1, 2), "1-URGENT") for k, p in ((1, 10.0), (946_684, 1234.56), (946_685, 0.25), (3_000_000, 99.995), (4_102_444, 7.5), (4_102_445, 8.0), (9_000_000, 1.0))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.execute("set TimeZone = 'UTC'")
    db.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert rows_of(plans.QUERIES["f16_fractions_and_untyped"](spark, str(tmp_path))) == rows_of_sql(db, plans.SQL["f16_fractions_and_untyped"])[1]


# lists are merged by whole scores


def test_merged_by_whole_scores(spark, tmp_path):
    """Vectors whose scores agree in six places alone are ranked by all of them, whatever their ids."""
    rng = random.Random(5)
    rows = [(0, [1.0, 0.0], 1)] + [(i, [1.0, 1e-4 * rng.random() + 0.3], 1 + i % 2) for i in range(1, 50)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = plans.QUERIES["u03_merged_top_k"](spark, str(tmp_path))
    assert rows_of(got) == rows_of_sql(db, plans.SQL["u03_merged_top_k"])[1]
    v = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r["score"] for r in retrieval.semantic_search(v, v.where("vec_id = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")), 3).collect()} == {1.0, 0.957826}


# a merge shuffles the stored rows once; what it stages is dealt as it is stored


def test_merge_is_staged_by_bucket(spark, monkeypatch):
    """Each staged file is of one bucket, so the swap shuffles nothing; null keys, repeated stored keys and kept columns are as before."""
    old = spark.createDataFrame([(f"k{i}", i, "old") for i in range(200)] + [("k7", 1000, "old"), (None, -1, "old")], "key string, n int, kept string").repartition(3)
    new = spark.createDataFrame([(f"k{i}", -i, "new") for i in range(0, 300, 3)] + [("k0", 5, "new"), (None, -2, "new")], "key string, n int, kept string")
    seen, swap = [], KeyedTable._swap
    monkeypatch.setattr(KeyedTable, "_swap", lambda self, made: (seen.append(made.select(F.input_file_name().alias("f"), BUCKET).distinct().groupBy("f").count().agg(F.max("count")).first()[0]), swap(self, made)))
    for keep in ((), ("kept",)):
        t = KeyedTable(shared_path(spark, "t"), ("key",), 16).create(old)
        t.upsert(new, [F.asc("n")], keep)
        newest = {}
        for k, n, _ in sorted(map(tuple, new.collect()), key=lambda r: -r[1]):
            newest[k] = n
        want = [("None" if k is None else k, n, "old" if keep and k in {f"k{i}" for i in range(200)} else "new") for k, n in newest.items()]
        want += [("None" if r[0] is None else r[0], r[1], "old") for r in map(tuple, old.collect()) if r[0] is None or r[0] not in newest]
        assert sorted((str(r[0]), r[1], r[2]) for r in t.read(spark).collect()) == sorted(want)
    t.replace(new.where("n < -100"))
    assert t.read(spark).where("n < -100").count() == new.where("n < -100").count()
    assert seen == [1, 1, 1]


# rows of a series are dealt by blocks, never by series


def test_series_are_never_in_one_task(spark):
    """No exchange of rows is by the series alone, even where few series make a broadcast look worse than a join by series."""
    rows = spark.range(20_000).select(F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("t"), F.col("id"), F.when(F.col("id") % 20 > 0, F.col("id").cast("double")).alias("a"), F.col("id").cast("double").alias("b"))
    made = timeseries.sheet_forecasts(rows, "t", ["a", "b"], ["id"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "__block" in plan
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("__block" in line for line in joins), joins
    got = {r["measure"]: r for r in made.collect()}
    assert got["a"]["missing_fraction"] == 0.05 and got["b"]["missing_fraction"] == 0 and got["a"]["n"] == got["b"]["n"] == 20_000


# Texts come to Python in batches of bounded bytes


def test_batches_of_texts_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    long = spark.range(400).coalesce(1).select(F.col("id").alias("document_id"), F.lit(1).alias("page"), F.repeat(F.lit("word "), 20_000).alias("content"))
    assert chunking.chunk_texts(long).count() == 400 * 50
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == BATCH_BYTES


# texts that can't be numbers are not cast


def test_numbers_are_read_as_by_a_cast(spark):
    texts = ["1", "-1.5", "+.5", "1e-5", "1E+5", "Infinity", "-inf", "NaN", "nan", "1d", "2f", "0x1p-3", "\x01 7 \x02", "1-5", "1/2", "2020-01-02", "1e5-3", "abc", "F", "1-URGENT", "", "-", ".", "n/a", None, "１", "٣"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", cells.read_number(F.col("t")).alias("a"), F.col("t").try_cast("double").alias("b"), cells.read_date(F.col("t")).alias("d"), F.when(F.col("t").try_cast("double").isNull(), cells.read_date(F.col("t"))).alias("e"))
    assert all(repr(r["a"]) == repr(r["b"]) and r["d"] == r["e"] for r in got.collect())
    plan = df.select(cells.read_number(F.col("t")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.upper()


def test_profiles_are_made_when_asked_for(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(ingest, "sheet_profile", lambda *a: asked.append(a) or spark.range(1))
    raw = spark.createDataFrame([("1", "2020-01-02"), ("2", "2020-01-03")], "n string, day string")
    parts = ingest.register_sheet(raw, shared_path(spark, "sheets"), "d", "s")
    assert [r["original_name"] for r in parts["columns"].orderBy("ordinal").collect()] == ["n", "day"] and not asked
    assert parts["profiles"].count() == 1 and parts["profiles"].count() == 1 and len(asked) == 1
    assert set(parts) == {"tables", "columns", "profiles", "series", "forecasts"}

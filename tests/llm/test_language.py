"""Language identification against a dense kernel ridge on sets of n-grams."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.llm.language_id import KernelParams, fit, held_out, op5_language_id, predict, presence

P = KernelParams()
LABELLED = [
    ("the cat and the dog are in the house", "en"), ("this is what we have been thinking of", "en"), ("there was nothing to be done about that", "en"), ("She walks. He runs!", "en"),
    ("der hund und die katze sind im haus", "de"), ("das ist nicht der weg nach hause", "de"), ("wir haben gestern lange geschlafen", "de"), ("Ich bin müde.", "de"),
]


def grams(text):
    t = "".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower())
    t = f" {re.sub(' +', ' ', t.lstrip(' '))} "
    return {t[k : k + n] for n in P.orders for k in range(len(t) - n + 1)}


def kernel(a, b):
    return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])


def ridge_scores(train, texts):
    """One-versus-rest scores of texts, languages in order, by kernel ridge over all of train."""
    langs = sorted({lang for _, lang in train})
    x = [grams(t) for t, _ in train]
    y = np.array([[float(lang == c) for c in langs] for _, lang in train])
    w = (1 / np.maximum(y.sum(0), 1))[y.argmax(1)] * len(y) / len(langs)
    a = np.linalg.solve(kernel(x, x) + P.ridge * len(y) / 100 * np.diag(1 / w), y)
    return kernel([grams(t) for t in texts], x) @ a


def test_predictions_equal_a_dense_kernel_ridge(spark):
    texts = ["the house of the dog", "die katze und das haus", "nothing", "xyz", "Привет как дела", "nach hause 12 gehen!", "A", "x " * 2000 + "the end of this"]
    labelled = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(LABELLED)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fit(labelled)).collect()}
    want = ridge_scores(LABELLED, texts)
    for k in range(len(texts)):
        e = np.exp(P.sharpness * (want[k] - want[k].max()))
        assert got[k]["best"] == pytest.approx(want[k].max(), abs=0.02) and got[k]["score"] == pytest.approx((e / e.sum()).max(), abs=0.05)
        if np.ptp(want[k]) > 0.05:
            assert got[k]["lang_pred"] == ["de", "en"][want[k].argmax()]


def test_query_equals_a_dense_kernel_ridge(spark):
    """Over the small table every labelled row is within the fit's bounds, so op5 is a kernel ridge but for its landmarks."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", held_out().alias("out")).collect()
    train = [(r["text"], r["lang"]) for r in rows if r["lang"] and not r["out"] and re.search(r"[^\W\d_]", r["text"] or "")]
    langs = sorted({lang for _, lang in train})
    got = {r["doc_id"]: r for r in op5_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    letters = [r for r in rows if re.search(r"[^\W\d_]", r["text"] or "")]
    want = ridge_scores(train, [r["text"] for r in letters])
    near = 0
    for r, s in zip(letters, want, strict=True):
        top = np.sort(s)
        assert got[r["doc_id"]]["held_out"] == r["out"]
        near += abs(got[r["doc_id"]]["best"] - top[-1]) < 0.1
        if top[-1] - top[-2] > 0.2:
            assert got[r["doc_id"]]["lang_pred"] == langs[s.argmax()]
    assert near >= 0.95 * len(letters)


def test_long_texts(spark):
    """Texts whose n-grams fill many of the buckets: the language is still found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.where(~held_out()))
    long = docs.where(held_out() & F.col("lang").isNotNull()).groupBy("lang").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).withColumn("text", F.expr("repeat(text, 3)")).withColumn("doc_id", F.monotonically_increasing_id())
    rows = long.withColumn("chars", F.length("text")).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in predict(long, model).collect()}
    assert all(r["chars"] > 20_000 for r in rows) and all(got[r["doc_id"]] == r["lang"] for r in rows) and presence("é" * 100_000, P) is not None


def test_repeated_ids_give_the_same_model(spark):
    rows = [(k // 4, t, lang) for k, (t, lang) in enumerate(LABELLED)]
    models = [fit(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(3), KernelParams(max_training=5)) for r in (rows, rows[::-1])]
    assert (models[0].landmarks == models[1].landmarks).all() and np.allclose(models[0].weights, models[1].weights)

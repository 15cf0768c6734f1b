"""Language identification with string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, claim, table, text_of, worker

UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


@dataclass(frozen=True)
class KernelParams:
    """per_language and max_training bound the labelled rows that the fit sees; landmarks are the first of them."""

    orders: tuple[int, ...] = (1, 2, 3, 4)
    buckets: int = 1 << 14
    per_language: int = 400
    max_training: int = 4096
    landmarks: int = 192
    ridge: float = 1e-2
    sharpness: float = 8.0
    rows_per_product: int = 128
    #: One-versus-rest targets are 1 and 0. Texts of other scripts and strings of random letters score up to about 0.05, the shortest clean texts 0.18 and more.
    reject_below: float = 0.06


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def presence(text: str, p: KernelParams) -> np.ndarray | None:
    """Which buckets the text's n-grams of all orders fall in, over lower-cased letters with one space between runs; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of others stands for the run
    c = np.where(is_letter, codes, 32)[keep].astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c, [np.uint64(32)]))
    on = np.zeros(p.buckets, np.uint8)
    shift = np.uint64(64 - int(p.buckets).bit_length() + 1)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(p.orders) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
        if n in p.orders:
            on[(h * np.uint64(0x9E3779B97F4A7C15)) >> shift] = 1
    return on


@dataclass
class KernelModel:
    """weights over landmarks: scores = kernel(texts, landmarks) @ weights."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    params: KernelParams

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return _kernel(rows, self.landmarks) @ self.weights


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared buckets over the geometric mean of the two counts: a positive semi-definite presence kernel."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    return (a @ b.T) / np.sqrt(np.maximum(a.sum(1), 1)[:, None] * np.maximum(b.sum(1), 1)[None, :])


def fit(labelled: DataFrame, params: KernelParams = KernelParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel | None:
    """Fit on at most per_language rows of each language and max_training in all; None if no row has a language and a letter.

    The rows are those with the smallest hash of their id, then in order of language and presence bits, so a run can be repeated; the window
    keeps a bounded number of rows a task before its shuffle. Only packed presence bits come to the driver: max_training times buckets / 8
    bytes. The table of shares is broadcast: at most max_training languages, the most frequent ones, as no more can be learned.
    """
    p = params
    given = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), text_of(text_col).alias("text")).where("lang is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    ids = given.select("id", "lang", "h")
    # a share of each language that holds about sixteen times as many rows as are taken, so that the window meets no more, however large the table
    share = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(p.max_training)
    share = share.select("lang", (F.lit(16.0 * p.per_language) / F.col("rows")).alias("share"))
    ids = ids.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < F.col("share") * (1 << 40)).drop("share")
    ids = ids.withColumn("rank", rank).where(F.col("rank") <= p.per_language).orderBy("rank", "lang").limit(p.max_training)
    chosen = ids.groupBy("id", "lang").agg(F.min("rank").alias("rank"))
    rows = given.join(F.broadcast(chosen), ["id", "lang"])

    @worker("language")
    def bits(batches):
        for b in batches:
            on = [presence(t.as_py(), p) for t in b.column("text")]
            packed = [None if x is None else np.packbits(x).tobytes() for x in on]
            yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("lang"), pa.array(packed, pa.binary())], ["rank", "lang", "bits"])

    got = rows.select("rank", "lang", "text").mapInArrow(bits, "rank int, lang string, bits binary").where("bits is not null").orderBy("rank", "lang", "bits").limit(p.max_training).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["rank"], r["lang"], bytes(r["bits"])))
    x = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: p.buckets] for r in got])
    languages = sorted({r["lang"] for r in got})
    marks = x[: p.landmarks]
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(np.float64))
    sound = values > 1e-6 * values.max()
    whiten = vectors[:, sound] / np.sqrt(values[sound])
    phi = _kernel(x, marks).astype(np.float64) @ whiten
    y = np.array([[float(r["lang"] == lang) for lang in languages] for r in got])
    # classes weigh alike, whatever their share of the sample
    w = (1 / np.maximum(y.sum(0), 1))[y.argmax(1)] * len(y) / len(languages)
    gram = (phi * w[:, None]).T @ phi + p.ridge * len(y) * np.eye(phi.shape[1]) / 100
    weights = whiten @ np.linalg.solve(gram, (phi * w[:, None]).T @ y)
    return KernelModel(languages, marks, weights.astype(np.float32), p)


def found_in(text: Column, model: KernelModel | None, spark: SparkSession) -> Column:
    """lang_pred, score (softmax of the one-versus-rest scores) and best (the largest of those scores) of a text, as a struct.

    Null text and text without a letter: und, score 0, best null. So is everything when the model is None. Whole texts count, in products of
    rows_per_product texts; only the text goes to Python, and only the struct comes back.
    """
    sent = bounded_batches(spark).sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, best double")
    def run(texts: pa.Array) -> pa.Array:
        claim("language")
        m = sent.value
        names, score, top = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
        step = m.params.rows_per_product if m else 1
        for at in range(0, len(texts) if m else 0, step):
            on = [(at + k, presence(t.as_py() or "", m.params)) for k, t in enumerate(texts.slice(at, step))]
            on = [(i, x) for i, x in on if x is not None]
            if on:
                raw = m.scores(np.stack([x for _, x in on])).astype(np.float64)
                s = raw * m.params.sharpness
                e = np.exp(s - s.max(1, keepdims=True))
                best = s.argmax(1)
                for (i, _), k, q, r in zip(on, best, (e / e.sum(1, keepdims=True))[np.arange(len(on)), best], raw.max(1), strict=True):
                    names[i], score[i], top[i] = m.languages[k], q, r
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(top, pa.float64())], ["lang_pred", "score", "best"])

    return run(text)


def predict(docs: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """id_col, the columns of extra, lang_pred, score and best (see found_in) for each row; one map pass.

    Null ids and repeated rows: one result each. An empty table gives an empty result; other columns are left out, so their names can't clash.
    """
    found = docs.select(F.col(id_col), *(c.alias(n) for n, c in (extra or {}).items()), found_in(text_of(text_col), model, docs.sparkSession).alias("_found"))
    return found.select(*[c for c in found.columns if c != "_found"], "_found.*")


def confident(docs: DataFrame, model: KernelModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text has a letter and a best score of at least the model's reject_below."""
    rows = docs.select(F.struct("*").alias("row"), found_in(text_of(text_col), model, docs.sparkSession).alias("found"))
    return rows.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.best") >= model.params.reject_below)).select("row.*")


def held_out(id_col: str = "doc_id") -> Column:
    """One row in five, by the CRC-32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~held_out())), extra={"held_out": held_out()})

"""From raw documents to packed training sequences, in five stages written and read again as Parquet.

language id, exact dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing: each works on all that the one before
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import text_of, written
from gridlore.llm.decontaminate import contaminated
from gridlore.llm.exact_dedup import exact_groups, flagged, sha256_of
from gridlore.llm.jaccard_join import jaccard_components
from gridlore.llm.language_id import confident, fit
from gridlore.llm.packing import packed_documents

#: Near-duplicate stages of the pipeline: shingles of five words, Jaccard similarity of at least 0.8.
SHINGLE_WORDS, NUM, DEN = 5, 80, 100
TOKENIZER, EOS, CAPACITY = "byte_bpe_50k.json", 2, 1024


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs less the rows whose id is in bad (one column, null for null). Only rows that a filter of bounded size can't clear are shuffled.

    The rows travel as one struct, so no column's name can clash.
    """
    bad = written(bad.toDF("bad").distinct(), "bad")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    marked = flagged(rows, bad.toDF("digest"), "id", "maybe")
    doubtful = marked.where("maybe").join(bad, F.col("id").eqNullSafe(F.col("bad")), "left_anti")
    return marked.where("not maybe").unionByName(doubtful).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: null text, no letter in it, or no learned language that scores reject_below or more.

    Learns from labelled rows of docs themselves; without any, texts that have a letter stay. Rows that repeat each count; a null id is no
    reason to go. An empty table gives an empty result.
    """
    model = fit(docs)
    if model is None:  # nothing to learn from: only texts without a letter can be told apart
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return confident(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays: the one with the smallest id (null ids come last); of rows that repeat it, one. Null counts as empty.

    What goes is found by id and digest, which no hot text makes a hot key. Rows that a filter of bounded size clears pass unshuffled.
    """
    found = exact_groups(docs, keep="smallest").where("group_size > 1").groupBy(F.col("doc_id").alias("i"), F.col("digest").alias("d"))
    found = written(found.agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1").withColumn("digest", F.xxhash64("i", "d")), "copies")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), sha256_of(text_of()).alias("d0"))
    marked = flagged(rows, found.select("digest"), F.xxhash64("id", "d0"), "maybe")
    doubtful = marked.where("maybe").join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("d0") == F.col("d")), "left")
    passed, one = doubtful.where("kept is null"), doubtful.where("kept").dropDuplicates(["id", "d0"])
    return marked.where("not maybe").select("row").unionByName(passed.select("row")).unionByName(one.select("row")).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: the one with the smallest id. Rows that share an id stay or go together."""
    found = jaccard_components(docs, SHINGLE_WORDS, NUM, DEN)
    return _without(docs, found.where("doc_id <> component_id").select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Rows that share an id stay or go together; null texts hold nothing; an empty benchmark takes none."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents to token sequences (see packed_documents); null texts count as empty, rows that repeat are packed each, an empty table gives none."""
    return packed_documents(docs, public_tokenizers.path(TOKENIZER), EOS, CAPACITY)


STAGES = [("language id", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]

#: SQL can't express language identification, near-duplicate components or packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Columns beyond those of documents are carried up to packing, under any name; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs

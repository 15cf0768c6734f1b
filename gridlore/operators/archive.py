"""The archive of fetched pages: saving, searching, recall through past searches, cached answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions.texts import excerpt, normal_query

from .tables import first_by, insert_if_absent, upsert
from .trigrams import TextIndex


def page_rows(pages: DataFrame) -> DataFrame:
    """url_hash, url, content, timestamp from url, content, timestamp."""
    return pages.select(F.md5("url").alias("url_hash"), "url", "content", "timestamp")


def save_pages(archive: DataFrame, pages: DataFrame, keep: str = "first") -> DataFrame:
    """archive with new pages; keep 'first' leaves known pages alone, 'last' takes the newest content."""
    new = page_rows(pages)
    if keep == "first":
        return insert_if_absent(archive, new, ["url_hash"], [F.asc("timestamp"), F.asc("content")])
    return upsert(archive, new, ["url_hash"], [F.desc("timestamp"), F.asc("content")])


def history_rows(searches: DataFrame) -> DataFrame:
    """query (normalised), url_hash, timestamp: rows to append to the history."""
    return searches.select(normal_query(F.col("query")).alias("query"), F.md5("url").alias("url_hash"), "timestamp")


def _matching(archive: DataFrame, text: str) -> DataFrame:
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    return archive.where(F.col("url").ilike(pattern) | F.col("content").ilike(pattern)) if text else archive


def page_index(path: str, buckets: int = 64) -> TextIndex:
    """A trigram index of an archive's addresses and contents; build(archive) makes it."""
    return TextIndex(path, "url_hash", ("url", "content"), buckets)


def candidate_pages(spark: SparkSession, index: TextIndex, text: str) -> DataFrame:
    """The archive's pages that may hold text, for search_pages, count_pages and recall, which verify them; all pages for a text without three characters in a row."""
    return index.candidates(spark, [text]) if text else index.rows(spark)


def recall_candidates(spark: SparkSession, index: TextIndex, history: DataFrame, query: str) -> DataFrame:
    """What recall needs of the archive: pages that may hold the text, and those that a search holding it has found."""
    term = query.lower().strip()
    by_search = history.where(F.col("query").contains(term)).select("url_hash").distinct()
    near = candidate_pages(spark, index, term)
    found = index.rows(spark).join(by_search, "url_hash", "left_semi")
    return near.unionByName(found).dropDuplicates(["url_hash"])


def search_pages(archive: DataFrame, text: str = "", limit: int = 20, cursor: tuple | None = None) -> DataFrame:
    """Newest pages that hold the text: url_hash, url, excerpt, timestamp, after the cursor (timestamp, url_hash), and one more than limit."""
    rows = _matching(archive, text)
    if cursor:
        at, key = F.lit(cursor[0]).cast(archive.schema["timestamp"].dataType), F.lit(cursor[1])
        rows = rows.where((F.col("timestamp") < at) | ((F.col("timestamp") == at) & (F.col("url_hash") > key)))
    return rows.orderBy(F.desc("timestamp"), "url_hash").limit(limit + 1).select("url_hash", "url", excerpt(F.col("content")).alias("excerpt"), "timestamp")


def count_pages(archive: DataFrame, text: str = "") -> DataFrame:
    return _matching(archive, text).agg(F.count(F.lit(1)).alias("total"))


def recall(archive: DataFrame, history: DataFrame, query: str, k: int = 3) -> DataFrame:
    """Newest distinct pages that were found by a search holding the text, or hold it themselves."""
    term = query.lower().strip()
    joined = archive.join(history.select("query", "url_hash"), "url_hash").where(F.col("query").contains(term) | F.lower("content").contains(term))
    return joined.select("url", "content", "timestamp").distinct().orderBy(F.desc("timestamp"), "url").limit(k)


def save_answers(answers: DataFrame, new: DataFrame) -> DataFrame:
    rows = new.withColumn("query", normal_query(F.col("query")))
    return upsert(answers, rows, ["query"], [F.desc("timestamp"), F.asc("answer")])


def cached_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (question_id, query) with the newest answer of their normalised text, null where there is none."""
    newest = first_by(answers, ["query"], [F.desc("timestamp"), F.asc("answer")]).select(F.col("query").alias("key"), "answer")
    return questions.withColumn("key", normal_query(F.col("query"))).join(newest, "key", "left").select("question_id", "query", "answer")

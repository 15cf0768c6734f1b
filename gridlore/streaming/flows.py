"""Running jobs: files to typed rows and chunks as they arrive, with a status for each, and the last time each source was seen."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlore.operators.chunking import chunk_texts
from gridlore.operators.freshness import status
from gridlore.operators.keyed import KeyedTable
from gridlore.operators.tables import first_by
from gridlore.shared import shared_path, written  # noqa: F401, callers take shared_path from here


def source_path(path: str) -> str:
    """path as a pattern, which a file stream takes for a single file as well as for a folder."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def ingest_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, size: int = 2000, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """New Parquet files of page texts (document_id, page, content; prepare makes them from other columns) to chunks under out, then stop.

    Each micro-batch overwrites its own partition, so a batch that runs again after a failure changes nothing; read_chunks
    settles documents that came twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        made = chunk_texts(prepare(batch), size).withColumn("status", F.lit("ready"))
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    pages = spark.readStream.schema(schema).parquet(source_path(source))
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks as an upsert by chunk_id leaves them: the latest batch of each document wins whole."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return first_by(rows.join(last, ["document_id", "batch"]), ["chunk_id"], [F.asc("content")]).drop("batch")


def last_seen_stream(spark: SparkSession, source: str, schema: str, key: str, time: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The newest time of each source over all files so far; sink gets the sources that changed (name, last_modified)."""
    rows = spark.readStream.schema(schema).parquet(source_path(source))
    newest = rows.groupBy(F.col(key).alias("name")).agg(F.max(time).alias("last_modified"))
    return newest.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_status(rows: DataFrame, ttl_minutes: int, now) -> DataFrame:
    return rows.withColumn("status", status(F.col("last_modified"), F.lit(ttl_minutes), F.lit(now).cast("timestamp_ntz")))


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
STATUS = "document_id string, path string, status string, row_count bigint, error string, modified timestamp"
FILES_PER_BATCH = 1_000


@dataclass(frozen=True)
class Store:
    """Where ingested files go: their statuses, typed rows and chunks, each a table keyed by document."""

    path: str
    buckets: int = 16

    def table(self, name: str) -> KeyedTable:
        return KeyedTable(f"{self.path}/{name}", ("document_id",), self.buckets)

    def put(self, name: str, rows: DataFrame) -> None:
        """Replace the rows of the documents that rows has, making the table if it isn't there."""
        t = self.table(name)
        try:
            rows.sparkSession.read.parquet(t.path)
        except AnalysisException:  # no such path yet
            t.create(rows)
        else:
            t.replace(rows)


def _uri(path: Column) -> Column:
    """One way of writing a path: file:/a and file:///a are the same."""
    return F.regexp_replace(path, "^([a-z0-9]+):/(?!/)", "$1:///")


def ingest_files(batch: DataFrame, store: Store, kind: str, schema: str, chunked: Callable[[DataFrame], DataFrame]) -> None:
    """One batch of files (path, modificationTime; one document each) into store: pending first, then ready with rows and chunks, or error with the reason.

    All files are read in one job. A file that can't be read, has no row, or holds a record that isn't of schema is an error; its rows and the
    others' are kept apart, and what the store had of it stays. Files of no bytes have no row in a file source, so they get no status. chunked makes chunks (document_id, ...) from rows. Everything is replaced by document,
    so a batch that comes again changes nothing.
    """
    spark = batch.sparkSession
    files = written(batch.select(_uri(F.col("path")).alias("path"), F.col("modificationTime").alias("modified")).withColumn("document_id", F.md5("path")), "files")
    paths = [r["path"] for r in files.select("path").collect()]  # FILES_PER_BATCH at most
    if not paths:
        return
    state = lambda df, status: df.select("document_id", "path", status.alias("status"), F.col("row_count").cast("bigint"), F.col("error").cast("string"), "modified")
    none = F.lit(None)
    store.put("documents", state(files.withColumns({"row_count": none, "error": none}), F.lit("pending")))
    # columns by their own types, as readers of self-describing formats take them; text formats also say which record is broken
    texts = kind in ("json", "csv")
    reader = spark.read.format(kind).schema(f"{schema}, _corrupt string" if texts else schema).option("ignoreCorruptFiles", "true")
    if texts:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("header", "true")
    rows = reader.load(paths).select("*", _uri(F.col("_metadata.file_path")).alias("path"))
    rows = written(rows if texts else rows.withColumn("_corrupt", none.cast("string")), "rows")
    seen = rows.groupBy("path").agg(F.count(F.lit(1)).alias("row_count"), F.count("_corrupt").alias("broken"))
    judged = files.join(seen, "path", "left").withColumn("error", F.when(F.col("row_count").isNull(), "no row could be read").when(F.col("broken") > 0, F.concat(F.col("broken").cast("string"), F.lit(" of "), F.col("row_count").cast("string"), F.lit(" records are broken"))))
    judged = written(judged, "judged")
    good = written(rows.drop("_corrupt").join(judged.where("error is null").select("path", "document_id"), "path").drop("path"), "good")
    store.put("rows", good)
    store.put("chunks", chunked(good))
    store.put("documents", state(judged.withColumn("row_count", F.when(F.col("error").isNull(), F.col("row_count"))), F.when(F.col("error").isNull(), "ready").otherwise("error")))


def file_stream(spark: SparkSession, source: str, store: Store, kind: str, schema: str, checkpoint: str, chunked: Callable[[DataFrame], DataFrame], files_per_batch: int = FILES_PER_BATCH) -> StreamingQuery:
    """New files under source into store, files_per_batch at a time, then stop (see ingest_files)."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(source).select("path", "modificationTime")
    return files.writeStream.foreachBatch(lambda b, _: ingest_files(b, store, kind, schema, chunked)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

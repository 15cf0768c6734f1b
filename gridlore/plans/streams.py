"""Queries that run a stream over the table's files to its end and return what it left."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.operators.chunking import chunk_texts
from gridlore.streaming import flows

from .questions import NOW
from .registry import SQL, query, table


@query(f"select *, 'ready' as status from ({SQL['k01_text_chunks']})")
def v01_ingest_stream(spark, sf_dir):
    out = flows.shared_path(spark, "chunks")
    schema = table(spark, sf_dir, "documents").schema.simpleString()[len("struct<") : -1]
    pages = lambda d: d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.col("text").alias("content"))
    flows.ingest_stream(spark, f"{sf_dir}/documents.parquet", schema.replace(":", " "), out, flows.shared_path(spark, "ingest"), prepare=pages).awaitTermination()
    return flows.read_chunks(spark, out)


_TYPED = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def status_flow(spark, sf_dir):
    """Documents as JSON files, one for each source and language; in those of source src1 the last character of every record is lost. The store after the stream."""
    files, store = flows.shared_path(spark, "files"), flows.Store(flows.shared_path(spark, "store"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    kept = F.concat_ws("-", "source", "lang")
    line = F.to_json(F.struct(*d.columns))
    broken = F.when(F.col("source") == "src1", F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    d.select(kept.alias("kind"), line.alias("line"), "source").select("kind", broken.alias("value")).repartition("kind").write.partitionBy("kind").text(files)
    chunks = lambda rows: chunk_texts(rows.select("document_id", F.col("doc_id").cast("int").alias("page"), F.col("text").alias("content")))
    flows.file_stream(spark, files, store, "json", _TYPED, flows.shared_path(spark, "status"), chunks).awaitTermination()
    return store


@query("select concat_ws('-', source, lang) as name, case when source = 'src1' then 'error' else 'ready' end as status, case when source <> 'src1' then count(*) end as row_count, case when source = 'src1' then count(*) || ' of ' || count(*) || ' records are broken' end as error from documents group by source, lang")
def v01_status_flow(spark, sf_dir):
    done = status_flow(spark, sf_dir).table("documents").read(spark)
    return done.select(F.regexp_extract("path", "kind=([^/]+)", 1).alias("name"), "status", "row_count", "error")


@query("select doc_id, text, lang, source, n_chars from documents where source <> 'src1'")
def v01_typed_rows(spark, sf_dir):
    return status_flow(spark, sf_dir).table("rows").read(spark).drop("document_id")


@query("select event_type as name, max(ts) as last_modified, case when epoch(timestamp '2024-01-15 12:00:00') - epoch(max(ts)) <= 36000 then 'fresh' else 'stale' end as status from events group by 1")
def v02_last_seen_stream(spark, sf_dir):
    out = flows.shared_path(spark, "seen")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    schema = table(spark, sf_dir, "events").schema.simpleString()[len("struct<") : -1]
    flows.last_seen_stream(spark, f"{sf_dir}/events.parquet", schema.replace(":", " "), "event_type", "ts", keep, flows.shared_path(spark, "last-seen")).awaitTermination()
    rows = spark.read.parquet(out).groupBy("name").agg(F.max("last_modified").alias("last_modified"))
    return flows.with_status(rows, 600, NOW.isoformat(" "))

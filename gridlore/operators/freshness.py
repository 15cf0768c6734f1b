"""Whether data sources are within their time to live, at a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions.cells import STAMP_FORMATS, parsed_time

NAME_RULE = "^[A-Za-z0-9_-]+$"
# Messages about a source's time.
NO_TIME, FUTURE_TIME = "No last modified timestamp available", "Last modified timestamp is in the future (clock skew)"


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1_000_000


def status(last_modified: Column, ttl_minutes: Column, now: Column) -> Column:
    """fresh up to and at the limit, and for times to come; stale beyond; unknown without a time."""
    age = seconds_between(now, last_modified)
    return F.when(last_modified.isNull(), "unknown").when(age <= ttl_minutes * 60, "fresh").otherwise("stale")


def enabled_sources(sources: DataFrame) -> DataFrame:
    """Sources that are on, with names by the rule in lower case and a time to live of at least a minute."""
    return sources.where(F.col("enabled") & F.col("name").rlike(NAME_RULE) & (F.col("ttl_minutes") >= 1)).withColumn("name", F.lower("name"))


def source_named(sources: DataFrame, name: str) -> DataFrame:
    return enabled_sources(sources).where(F.col("name") == name.lower())


def newest_by_source(rows: DataFrame, source: str, time: str) -> DataFrame:
    """name, last_modified: the newest time of each source, folded before its shuffle."""
    return rows.groupBy(F.col(source).alias("name")).agg(F.max(time).alias("last_modified"))


def newest_time(rows: DataFrame, time: str) -> DataFrame:
    """One row, last_modified: the newest of times. Times kept as texts are compared as texts, and the greatest is read in any of STAMP_FORMATS; null if it is in none, or there is none."""
    newest = F.max(time)
    if dict(rows.dtypes)[time] == "string":
        newest = parsed_time(newest, STAMP_FORMATS).cast("timestamp_ntz")
    return rows.agg(newest.alias("last_modified"))


def details(sources: DataFrame, now: Column) -> DataFrame:
    """sources (name, type, ttl_minutes, description, last_modified, fetch_error) with status, ages and what is left, as of now."""
    age = seconds_between(now, F.col("last_modified"))
    failed = F.col("fetch_error").isNotNull() & F.col("last_modified").isNull()
    shown = F.when(~failed & F.col("last_modified").isNotNull(), F.greatest(age, F.lit(0.0)))
    left = F.when(~failed & F.col("last_modified").isNotNull(), F.when(age < 0, F.col("ttl_minutes") * 60.0).otherwise(F.col("ttl_minutes") * 60.0 - age))
    note = F.when(F.col("last_modified").isNull(), NO_TIME).when(age < 0, FUTURE_TIME)
    return sources.select(
        F.col("name").alias("source_name"), F.col("type").alias("source_type"), F.when(failed, "error").otherwise(status(F.col("last_modified"), F.col("ttl_minutes"), now)).alias("status"), "ttl_minutes",
        F.when(~failed, F.col("last_modified")).alias("last_modified"), F.round(shown / 60, 2).alias("age_minutes"), F.round(shown, 2).alias("age_seconds"), F.round(left / 60, 2).alias("time_until_stale_minutes"), F.round(left, 2).alias("time_until_stale_seconds"),
        "description", F.when(failed, F.col("fetch_error")).otherwise(F.coalesce(note, "fetch_error")).alias("error_message"), now.alias("checked_at"),
    )


def overview(rows: DataFrame) -> DataFrame:
    """One row: counts by status and the status of all."""
    n = {s: F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("fresh", "stale", "error", "unknown")}
    counts = rows.agg(F.count(F.lit(1)).alias("total_sources"), *n.values())
    overall = (
        F.when(F.col("stale_count") > 0, "stale").when(F.col("error_count") > 0, "error").when((F.col("unknown_count") > 0) & (F.col("fresh_count") == 0), "unknown").when(F.col("fresh_count") > 0, "fresh").otherwise("unknown")
    )
    return counts.withColumn("overall_status", overall)

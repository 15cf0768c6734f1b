"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"two queries named {name}")
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def keep(run: Query) -> Query:
        register(run.__name__, run, sql)
        return run

    return keep


def over(name: str, source: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Register a query over one table."""
    register(name, lambda spark, sf_dir: run(table(spark, sf_dir, source)), sql)

"""Keyed writes and lookups over Parquet tables: insert-if-absent, upsert, replace, delete, scoped listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order; a pre-shuffle top-1 per task keeps hot keys small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """old plus the first row of each key of new that old lacks."""
    return old.unionByName(first_by(new, keys, order).join(old.select(*keys), list(keys), "left_anti").select(old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """One row for each key: new's first in the order, else old's. Columns in keep stay as old has them."""
    fresh = first_by(new, keys, order)
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep])
        fresh = fresh.join(before, list(keys), "left").withColumns({c: F.coalesce(f"__old_{c}", c) for c in keep})
    return old.join(fresh.select(*keys), list(keys), "left_anti").select(old.columns).unionByName(fresh.select(old.columns))


def update_columns(old: DataFrame, change: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with change's other columns where a key has a change and the changed value is not null."""
    columns = [c for c in change.columns if c not in keys]
    renamed = change.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    return old.join(renamed, list(keys), "left").withColumns({c: F.coalesce(f"__new_{c}", c) for c in columns}).select(old.columns)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def delete_keys(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the gone keys. Nothing is written here, so a caller swaps all tables or none."""
    return {name: delete_keys(t, gone, [key]) for name, t in tables.items()}


def replace_partition(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write df over the partitions that it has rows for; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replaced_partition(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """What replace_partition leaves, as a DataFrame."""
    return delete_keys(old, new, by).select(old.columns).unionByName(new.select(old.columns))


def in_scope(df: DataFrame, ids: Sequence[str] | None, status: str | None = "status", key: str = "document_id") -> DataFrame:
    """Rows of the given ids; without ids, rows that are ready."""
    if ids:
        return df.where(F.col(key).isin(list(ids)))
    return df.where(F.col(status) == "ready") if status else df


def listed(df: DataFrame, ids: Sequence[str], order: Sequence[str], key: str = "document_id") -> DataFrame:
    """Rows of the given ids in order; no ids, no rows."""
    found = df.where(F.col(key).isin(list(ids)) if ids else F.lit(False))
    return found.orderBy(*order) if order else found


def looked_up(df: DataFrame, **keys: str) -> DataFrame:
    """The rows whose columns have the given values; the comparison reaches the scan. An unknown column is an error of Spark, a null value finds nothing."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def table_of(tables: DataFrame, document_id: str, sheet_name: str) -> DataFrame:
    """The registry's row of one sheet: one row, or none."""
    return looked_up(tables, document_id=document_id, sheet_name=sheet_name).limit(1)


def default_sheet(tables: DataFrame, document_id: str) -> DataFrame:
    """The registry's row of the sheet that sorts first; none for an unknown document."""
    return looked_up(tables, document_id=document_id).orderBy("sheet_name").limit(1)


def columns_of(columns: DataFrame, document_id: str, sheet_name: str) -> DataFrame:
    """One sheet's columns in ordinal order."""
    return looked_up(columns, document_id=document_id, sheet_name=sheet_name).orderBy("ordinal")


def columns_by_table(columns: DataFrame, ids: Sequence[str]) -> DataFrame:
    """For each table of the ids its columns in ordinal order, as an array."""
    one = F.struct("ordinal", "original_name", "logical_type")
    return listed(columns, ids, []).groupBy("document_id", "sheet_name").agg(F.array_sort(F.collect_list(one)).alias("columns"))


def requested_with_table(requested: DataFrame, tables: DataFrame) -> DataFrame:
    """Requested ids (id, pos) that have a table, in requested order."""
    return requested.join(tables.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi").orderBy("pos")


def ready_tables(tables: DataFrame, documents: DataFrame) -> DataFrame:
    return tables.join(documents.where("status = 'ready'").select("document_id"), "document_id", "left_semi")


def with_chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents with the number of their chunks, newest first."""
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(n, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint"))).orderBy(F.desc("uploaded_at"), "document_id")


def status_count(documents: DataFrame, status: str = "ready") -> DataFrame:
    return documents.agg(F.count_if(F.col("status") == status).alias("n"))


def row_numbers(df: DataFrame, name: str = "_source_row_number") -> DataFrame:
    """Rows numbered from 1 in file order, without a global sort: counts per partition make offsets.

    df must read its rows in the same partitions each time, as a scan of fixed files does.
    """
    id_ = "__id"
    marked = df.withColumn(id_, F.monotonically_increasing_id())
    counts = marked.groupBy(F.shiftright(id_, 33).alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))  # a row for each partition
    numbered = marked.withColumn("__part", F.shiftright(id_, 33)).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(name, F.col(id_).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1).select(name, *df.columns)


def number_in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], block: Column, name: str, start: int = 0) -> DataFrame:
    """name numbers each key's rows in order. Rows are sorted block by block, and counts of the blocks before give a block's first number.

    block must not be null and must never fall along the order, as a rounded-down number or day does not; it decides how much one task sorts.
    """
    marked = df.withColumn("__block", block)
    counts = marked.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(*order))
    joined = with_offsets(marked.withColumn("__place", place), offsets, keys)
    return joined.withColumn(name, F.col("__place") - 1 + start + F.col("__before")).drop("__place", "__before", "__block")


def with_offsets(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the other columns of offsets, which has a row for each of the keys and __block; null keys meet."""
    names = [f"__k{i}" for i in range(len(keys))]
    right = offsets.withColumnsRenamed({**dict(zip(keys, names, strict=True)), "__block": "__b"})
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    on = F.col("__block") == F.col("__b")
    for c in same:
        on = on & c
    return rows.join(right, on).drop(*names, "__b")

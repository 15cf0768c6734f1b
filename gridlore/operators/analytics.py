"""The nine operations over one table: counts, sums, extremes, grouped counts and sums, and row selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions.filters import Filter, PlanError, apply_filters, column, visible

ROW_NUMBER = "_source_row_number"
GROUP_CAP, ROW_CAP, DEFAULT_ROWS = 1000, 500, 50
OPERATIONS = ("count_rows", "count_distinct", "sum", "avg", "min", "max", "groupby_count", "groupby_sum", "select_rows")


def clamp(n: int | None, cap: int, default: int = DEFAULT_ROWS) -> int:
    return min(max(1, default if n is None else int(n)), cap)


def _target(df: DataFrame, name: str | None, operation: str, numeric: bool = False) -> Column:
    seen = visible(df)
    if not name:
        raise PlanError(f"{operation} needs a column")
    if name not in seen:
        raise PlanError(f"unknown column: {name}")
    if numeric and seen[name] not in ("integer", "float"):
        raise PlanError(f"{operation} needs a number, {name} is {seen[name]}")
    return column(df, name)


def count_rows(df: DataFrame, filters: Iterable[Filter] = ()) -> DataFrame:
    return apply_filters(df, filters).agg(F.count(F.lit(1)).alias("count"))


def count_distinct(df: DataFrame, target: str, filters: Iterable[Filter] = (), rsd: float | None = None) -> DataFrame:
    """Distinct values that are not null; with rsd, an estimate of that relative deviation from one fixed-size sketch."""
    c = _target(df, target, "count_distinct")
    return apply_filters(df, filters).agg((F.count_distinct(c) if rsd is None else F.approx_count_distinct(c, rsd)).alias("count_distinct"))


def sum_of(df: DataFrame, target: str, filters: Iterable[Filter] = ()) -> DataFrame:
    """The sum; 0 where nothing was summed."""
    c = _target(df, target, "sum", numeric=True)
    return apply_filters(df, filters).agg(F.coalesce(F.sum(c), F.lit(0).cast(df.schema[target].dataType)).alias("sum"))


def avg_of(df: DataFrame, target: str, filters: Iterable[Filter] = ()) -> DataFrame:
    return apply_filters(df, filters).agg(F.round(F.avg(_target(df, target, "avg", numeric=True)), 4).alias("avg"))


def min_of(df: DataFrame, target: str, filters: Iterable[Filter] = ()) -> DataFrame:
    return apply_filters(df, filters).agg(F.min(_target(df, target, "min")).alias("min"))


def max_of(df: DataFrame, target: str, filters: Iterable[Filter] = ()) -> DataFrame:
    return apply_filters(df, filters).agg(F.max(_target(df, target, "max")).alias("max"))


def _order(order: str | None, value: str, default: str) -> list[Column]:
    """Sort columns for an order by value or key; value_* and count_* mean the same. Ties follow the key."""
    name = (order or default).replace("count_", "value_")
    orders = {"value_desc": [F.desc(value), F.asc("key")], "value_asc": [F.asc(value), F.asc("key")], "key_asc": [F.asc("key")], "key_desc": [F.desc("key")]}
    if name not in orders:
        raise PlanError(f"unknown order: {order}")
    return orders[name]


def groupby_count(df: DataFrame, group_by: str, filters: Iterable[Filter] = (), order: str | None = None, top_n: int | None = None) -> DataFrame:
    """key, count: rows of each value of the column, null among them; the first top_n in the order."""
    grouped = apply_filters(df, filters).groupBy(_target(df, group_by, "groupby_count").alias("key")).agg(F.count(F.lit(1)).alias("count"))
    return grouped.orderBy(*_order(order, "count", "value_desc")).limit(clamp(top_n, GROUP_CAP))


def groupby_sum(df: DataFrame, group_by: str, target: str, filters: Iterable[Filter] = (), order: str | None = None, top_n: int | None = None) -> DataFrame:
    """key, value: the sum for each key. A sum of nulls sorts as null and shows as 0."""
    if not group_by:
        raise PlanError("groupby_sum needs a key")
    c = _target(df, target, "groupby_sum", numeric=True)
    grouped = apply_filters(df, filters).groupBy(_target(df, group_by, "groupby_sum").alias("key")).agg(F.sum(c).alias("value"))
    first = grouped.orderBy(*_order(order, "value", "value_desc")).limit(clamp(top_n, GROUP_CAP))
    return first.select("key", F.coalesce("value", F.lit(0).cast(first.schema["value"].dataType)).alias("value"))


def select_rows(df: DataFrame, columns: Sequence[str] = (), filters: Iterable[Filter] = (), limit: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Chosen or all visible columns of the first rows, in order of row number where the table has one (or of order_by)."""
    chosen = [_target(df, c, "select_rows") for c in (columns or visible(df))]
    kept = apply_filters(df, filters)
    by = [ROW_NUMBER] if ROW_NUMBER in df.columns else list(order_by)
    return (kept.orderBy(*by) if by else kept).limit(clamp(limit, ROW_CAP)).select(*chosen)


def ordered_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Named columns first, the other visible ones after them, hidden ones left out."""
    seen = list(visible(df))
    head = [c for c in first if c in seen]
    return df.select(*[column(df, c) for c in head + [c for c in seen if c not in head]])


def exceeds_profile(result: DataFrame, value: str, row_count: DataFrame) -> DataFrame:
    """result and row_count are one row each; warning: whether the result is more than the table's profiled rows."""
    limit = row_count.select(F.col(row_count.columns[0]).alias("row_count"))
    return result.join(F.broadcast(limit.limit(1)), F.lit(True)).withColumn("warning", F.col(value) > F.col("row_count"))

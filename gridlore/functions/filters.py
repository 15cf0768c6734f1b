"""Filter operators over one table, checked against its schema and built as predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = ("gt", "gte", "lt", "lte")
TEXT = ("contains", "startswith")
DATES = ("year_equals", "month_equals", "between_dates")
NULLS = ("is_null", "is_not_null")
OPERATORS = ("eq", "neq", *ORDERED, *TEXT, *DATES, *NULLS)


class PlanError(ValueError):
    """An operation or filter that the table's schema does not allow."""


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None


def logical_type(field: T.StructField) -> str:
    """string, integer, float, date or boolean: the field's metadata if it says so, else by its type."""
    if "logical_type" in (field.metadata or {}):
        return field.metadata["logical_type"]
    t = field.dataType
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    return "string"


def visible(df: DataFrame) -> dict[str, str]:
    """Columns that users see, with their logical types; names that start with an underscore are hidden."""
    return {f.name: logical_type(f) for f in df.schema.fields if not f.name.startswith("_")}


def column(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def _day(text: Any) -> date:
    try:
        return datetime.fromisoformat(str(text)).date()
    except ValueError as e:
        raise PlanError(f"not an ISO date: {text!r}") from e


def _literal(df: DataFrame, name: str, value: Any) -> Column:
    """value as the column's own type, so that the comparison needs no cast of the column."""
    field = df.schema[name]
    kind = logical_type(field)
    if kind == "date" and isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            value = datetime(1970, 1, 1) + timedelta(seconds=value)
        return F.lit(str(value)).cast(field.dataType)
    if kind == "boolean":
        return F.lit(value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "1.0"))
    if kind == "string":
        return F.lit(str(value))
    if isinstance(value, str):
        try:
            value = float(value) if kind == "float" else int(float(value))
        except ValueError as e:
            raise PlanError(f"not a number: {value!r}") from e
    if kind == "integer" and isinstance(value, float) and not value.is_integer():
        return F.lit(value)
    return F.lit(value).cast(field.dataType)


def _range(df: DataFrame, name: str, first: date, end: date) -> Column:
    """first <= column < end on the raw column, which Parquet can prune by."""
    c = column(df, name)
    return (c >= _literal(df, name, first.isoformat())) & (c < _literal(df, name, end.isoformat()))


def _month(value: Any) -> tuple[date, date]:
    try:
        first = datetime.strptime(str(value), "%Y-%m").date()
    except ValueError as e:
        raise PlanError(f"month_equals needs 'YYYY-MM', not {value!r}") from e
    return first, date(first.year + first.month // 12, first.month % 12 + 1, 1)


def like_pattern(value: str, literal: bool) -> str:
    """value inside a LIKE pattern: a backslash is always itself; % and _ stay wildcards unless literal."""
    value = value.replace("\\", "\\\\")
    return value.replace("%", "\\%").replace("_", "\\_") if literal else value


def check(df: DataFrame, f: Filter) -> str:
    """The column's logical type, or PlanError if the filter can't apply to it."""
    seen = visible(df)
    if f.column not in seen:
        raise PlanError(f"unknown column: {f.column}")
    if f.operator not in OPERATORS:
        raise PlanError(f"unknown operator: {f.operator}")
    kind = seen[f.column]
    if f.operator not in NULLS and f.value is None:
        raise PlanError(f"{f.operator} needs a value")
    if f.operator in ORDERED and kind not in ("integer", "float", "date"):
        raise PlanError(f"{f.operator} does not apply to {kind}")
    if f.operator in TEXT and kind != "string":
        raise PlanError(f"{f.operator} does not apply to {kind}")
    if f.operator in DATES and kind != "date":
        raise PlanError(f"{f.operator} does not apply to {kind}")
    return kind


def predicate(df: DataFrame, f: Filter, *, literal: bool = False, case_sensitive: bool = False) -> Column:
    """One filter as a predicate. Null cells pass is_null alone.

    literal: % and _ in the value stand for themselves. case_sensitive: startswith then reaches the Parquet scan.
    """
    check(df, f)
    c = column(df, f.column)
    if f.operator == "is_null":
        return c.isNull()
    if f.operator == "is_not_null":
        return c.isNotNull()
    if f.operator == "year_equals":
        try:
            year = int(f.value)
            return _range(df, f.column, date(year, 1, 1), date(year + 1, 1, 1))
        except (TypeError, ValueError) as e:
            raise PlanError(f"not a year: {f.value!r}") from e
    if f.operator == "month_equals":
        return _range(df, f.column, *_month(f.value))
    if f.operator == "between_dates":
        if not isinstance(f.value, (list, tuple)) or len(f.value) != 2:
            raise PlanError("between_dates needs two dates")
        return _range(df, f.column, _day(f.value[0]), _day(f.value[1]) + timedelta(days=1))
    if f.operator in TEXT:
        if case_sensitive and literal:
            return c.startswith(str(f.value)) if f.operator == "startswith" else c.contains(str(f.value))
        pattern = ("%" if f.operator == "contains" else "") + like_pattern(str(f.value), literal) + "%"
        return c.like(pattern) if case_sensitive else c.ilike(pattern)
    v = _literal(df, f.column, f.value)
    return {"eq": c == v, "neq": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[f.operator]


def apply_filters(df: DataFrame, filters: Iterable[Filter] = ()) -> DataFrame:
    """Rows that pass every filter."""
    made = [predicate(df, f) for f in filters]
    return df.where(reduce(lambda a, b: a & b, made)) if made else df


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """Whether the text holds one of the terms, whatever their case."""
    return reduce(lambda a, b: a | b, [F.lower(c).contains(t.lower()) for t in terms], F.lit(False))

"""What a question asks for: routes, predictions, rows, column values, files and row counts, as expressions over a query log."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import stripped

# Patterns that a question is matched with, all without regard to case.
AGGREGATION = (
    r"\bhow many\b", r"\bcount\b", r"\bnumber of\b", r"\bdistinct\b", r"\bunique\b", r"\bbreakdown\b", r"\bgroup by\b", r"\baverage\b",
    r"\bmean\b", r"\bsum\b", r"\btotal\b", r"\bmin(?:imum)?\b", r"\bmax(?:imum)?\b", r"\blowest\b", r"\bhighest\b",
)
LISTING = (
    r"\blist\b", r"\bshow\b", r"\bfind\b", r"\bget\b", r"\bwhat are\b", r"\bwho are\b", r"\bwhich\b", r"\bfilter\b", r"\bfrom\s+\w+\b",
    r"\bwhere\b", r"\bcustomers?\s+(?:from|in|with|where)\b", r"\b(?:names?|emails?|addresses?)\s+of\b",
)
PREDICTIVE = ("predict", "forecast", "next month", "next quarter", "next year", "future", "projection", "expect")
PREDICTIVE_WITH_WILL = ("sales", "revenue", "grow", "trend", "value")
ROW = (
    (r"\brow\s+(\d+)\b", 1.0), (r"#(\d+)\b", 0.9), (r"\b(\d+)(?:st|nd|rd|th)\s+(?:row|customer|entry|record|item)\b", 0.95),
    (r"\b(?:customer|entry|record|item)\s+#?(\d+)\b", 0.85),
)
COLUMN_VALUE = (
    (r"(?:has|with|where)\s+(?:value\s+)?(\S+)\s+in\s+(?:the\s+)?(\w+)\s+(?:column|field)", "value_first"),
    (r"\b(\d[\d.]*)\s+in\s+(?:the\s+)?(\w+)\s+(?:column|field)", "value_first"),
    (r"\b(\w+)\s+(?:column|field)\s+(?:is|=|equals)\s+(\S+)", "column_first"),
    (r"where\s+(?:the\s+)?(\w+)\s+(?:is|=|equals)\s+(\S+)", "column_first"),
    (r"\b(index|id|code|number|num|no)\s+(\d+)\b", "column_first"),
)
FILE_FROM = r"""from\s+(?:the\s+)?['"]?([a-zA-Z0-9_\-]+(?:-\d+)?(?:\.[a-zA-Z0-9]+)?)['"]?\s*(?:file|document)?"""
FILE_IN = r"""in\s+(?:the\s+)?['"]?([a-zA-Z0-9_\-]+(?:-\d+)?(?:\.[a-zA-Z0-9]+)?)['"]?\s+(?:file|document)"""
LAST = r"\b(?:last|final|latest|most recent|bottom)\b"
ROW_COUNT = (r"\b(?:first|top)\s+(\d+)\b", r"\b(?:limit|only|just)\s+(\d+)\b", r"\b(\d+)\s+rows?\b")
ROW_COUNT_CAP = 500
LINE_CHART, BAR_CHART = ("trend", "over time", "forecast", "predict"), ("compare", "distribution", "by category")
# Classes and word boundaries are those of Unicode, as in (?U). DIGITS: those of other scripts that Java's strings hold in one unit.
DIGITS = "".join(chr(i) for i in range(128, 0x10000) if unicodedata.category(chr(i)) == "Nd")


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def _group(c: Column, pattern: str, n: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, f"(?iU){pattern}", n), F.lit(""))


def _number(c: Column) -> Column:
    """Digits of any script as a number; null if that is too large."""
    return F.translate(c, DIGITS, "".join(str(unicodedata.decimal(d)) for d in DIGITS)).try_cast("bigint")


def route(c: Column) -> Column:
    """empty_query, aggregation_intent, list_filter_intent or default_rag."""
    return (
        F.when(stripped(F.coalesce(c, F.lit(""))) == "", "empty_query").when(_any(c, AGGREGATION), "aggregation_intent")
        .when(_any(c, LISTING), "list_filter_intent").otherwise("default_rag")
    )


def is_predictive(c: Column) -> Column:
    held = lambda words: F.lower(c).rlike("|".join(words))
    return F.coalesce(held(PREDICTIVE) | (F.lower(c).contains("will") & held(PREDICTIVE_WITH_WILL)), F.lit(False))


def row_intent(c: Column) -> Column:
    """struct(row_number, confidence) of the first pattern with a number above 0; null without one."""
    found = []
    for pattern, confidence in ROW:
        n = _number(_group(c, pattern))
        found.append(F.when(n > 0, F.struct(n.alias("row_number"), F.lit(confidence).alias("confidence"))))
    return F.coalesce(*found)


def column_value_intent(c: Column) -> Column:
    """struct(column_name, value, confidence) of the first pattern that matches; null without one."""
    found = []
    for pattern, order in COLUMN_VALUE:
        name, value = (2, 1) if order == "value_first" else (1, 2)
        found.append(F.when(_group(c, pattern, 0).isNotNull(), F.struct(_group(c, pattern, name).alias("column_name"), _group(c, pattern, value).alias("value"), F.lit(0.9).alias("confidence"))))
    return F.coalesce(*found)


def file_intent(c: Column) -> Column:
    return F.coalesce(_group(c, FILE_FROM), _group(c, FILE_IN))


def wants_last(c: Column) -> Column:
    return F.coalesce(c.rlike(f"(?iU){LAST}"), F.lit(False))


def intent(c: Column) -> Column:
    return F.struct(row_intent(c).alias("row_intent"), column_value_intent(c).alias("column_value"), file_intent(c).alias("filename"), wants_last(c).alias("wants_last"))


def requested_rows(c: Column) -> Column:
    """How many rows the question asks for, at most 500; null when it doesn't say."""
    n = F.coalesce(*[_number(_group(c, p)) for p in ROW_COUNT])
    return F.when(n > ROW_COUNT_CAP, ROW_COUNT_CAP).otherwise(n)


def chart_type(c: Column) -> Column:
    q = F.lower(c)
    return F.when(q.rlike("|".join(LINE_CHART)), "line_chart").when(q.rlike("|".join(BAR_CHART)), "bar_chart").otherwise("line_chart")

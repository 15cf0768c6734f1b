"""Types of raw text cells, their values, names and texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import column, logical_type

#: Notations of dates that cells are read in, in this order.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")
#: Notations of stored timestamps.
STAMP_FORMATS = DATE_FORMATS[:4]
TRUE_TEXT, BOOLEAN_TEXT = ("true", "yes", "1", "1.0"), ("true", "false", "yes", "no", "0", "1")
DATE_SHARE, NUMBER_SHARE = 0.8, 0.9
TYPES = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "date": "timestamp_ntz"}


#: What counts as white space at the ends of a cell.
WHITE = "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def stripped(c: Column) -> Column:
    """Without white space at either end, and null where nothing else is there."""
    return F.nullif(F.btrim(c, F.lit(WHITE)), F.lit(""))


def parsed_time(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The time that a text tells in one of the notations. Each text has the shape of one notation at most, so no more than one is tried."""
    out = None
    for f in formats:
        hit, value = c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.when(c.rlike(r"^[+-]?\d+[-/]\d"), out)


def _shape(notation: str) -> str:
    """A pattern that all texts in the notation match."""
    parts = re.findall(r"y+|S+|[MdHms]+|'[^']*'|.", notation)
    return "^" + "".join(r"[+-]?\d{4,}" if p[0] == "y" else r"\d{1,6}" if p[0] == "S" else r"\d{1,2}" if p[0] in "MdHms" else re.escape(p.strip("'")) for p in parts) + "$"


#: No number has this, all dates do.
_BETWEEN = r"\d[-/]\d"


def read_date(c: Column) -> Column:
    """A text cell's time; text that reads as a number is never one."""
    return F.when(c.rlike(_BETWEEN), parsed_time(stripped(c)))


def read_number(c: Column) -> Column:
    """The number that a text tells. Only texts that begin as numbers do (infinity and NaN too) are cast: a cast that fails costs far more than a look."""
    return F.when(c.rlike(r"^[\x00-\x20]*[+-]?[.0-9iInN]") & ~c.rlike(_BETWEEN), c.try_cast("double"))


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """Each column's logical type from all its cells, in one pass.

    Text: date where at least 0.8 of the cells read as one; boolean where all are truth words; integer or float where at
    least 0.9 are numbers; else string. Whole floats are integers. A column without a value is string.
    """
    names = list(columns or df.columns)
    aggs, typed, cells = [], {}, []
    for i, name in enumerate(names):
        kind, c, s = logical_type(df.schema[name]), column(df, name), F.col(f"c{i}")
        text = kind == "string" and isinstance(df.schema[name].dataType, T.StringType)
        cells.append((stripped(c) if text else c).alias(f"c{i}"))
        aggs.append(F.count(s).alias(f"n{i}"))
        if text:
            number = read_number(s)
            aggs += [
                F.count(read_date(s)).alias(f"d{i}"), F.count_if(F.lower(s).isin(*BOOLEAN_TEXT)).alias(f"b{i}"),
                F.count(number).alias(f"f{i}"), F.count_if(number == F.floor(number)).alias(f"w{i}"),
            ]
        elif kind == "float":
            aggs.append(F.count_if(s == F.floor(s)).alias(f"w{i}"))
        typed[i] = kind
    df = df.select(*cells)
    got = df.agg(*aggs).first().asDict()
    out = {}
    for i, name in enumerate(names):
        n, kind = got[f"n{i}"], typed[i]
        if not n:
            out[name] = "string"
        elif f"d{i}" in got:
            if got[f"d{i}"] >= DATE_SHARE * n:
                out[name] = "date"
            elif got[f"b{i}"] == n:
                out[name] = "boolean"
            elif got[f"f{i}"] >= NUMBER_SHARE * n:
                out[name] = "integer" if got[f"w{i}"] == got[f"f{i}"] else "float"
            else:
                out[name] = "string"
        elif kind == "float":
            out[name] = "integer" if got[f"w{i}"] == n else "float"
        else:
            out[name] = kind
    return out


def normalized(c: Column, kind: str) -> Column:
    """A text cell's value as the logical type: null where it can't be read, but false for any boolean that isn't a true word."""
    s = stripped(c.cast("string"))
    if kind == "date":
        return read_date(c.cast("string")).cast("timestamp_ntz")
    if kind == "boolean":
        return F.when(s.isNotNull(), F.lower(s).isin(*TRUE_TEXT))
    if kind == "integer":
        return s.try_cast("double").try_cast("bigint")
    if kind == "float":
        return s.try_cast("double")
    return s


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) if hasattr(F, "timestamp_diff") else F.unix_timestamp(c.cast("timestamp"))


def safe_names(headers: Sequence[str]) -> dict[str, str]:
    """Physical names: lower case, other characters as one underscore, col_ before, and _2, _3 where names meet."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    last: dict[str, int] = {}  # the number that a base name's latest bearer has
    for header in map(str, headers):
        base = "col_" + (re.sub(r"[^a-zA-Z0-9]+", "_", header.strip().lower()).strip("_") or "col")
        name = base
        while name in taken:
            last[base] = last.get(base, 1) + 1
            name = f"{base}_{last[base]}"
        taken.add(name)
        out[header] = name
    return out


def safe_name_column(header: Column) -> Column:
    """The physical name of a header held as data, before clashes are settled."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(header)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("col_"), F.coalesce(F.nullif(base, F.lit("")), F.lit("col")))


def table_name(document_id: Column, sheet: Column) -> Column:
    base = F.regexp_replace(F.substring(F.regexp_replace(document_id, "[^a-zA-Z0-9_]+", "_"), 1, 24), "^_+|_+$", "")
    return F.concat(F.lit("doc_"), F.coalesce(F.nullif(base, F.lit("")), F.lit("doc")), F.lit("__"), F.substring(F.sha1(sheet), 1, 10))


def row_text(df: DataFrame, columns: Sequence[str], headers: Sequence[str | None] | None = None) -> Column:
    """Header=value of each cell with something in it, joined by commas; a missing header is ColN."""
    headers = list(columns) if headers is None else list(headers)
    parts = []
    for i, name in enumerate(columns):
        text = column(df, name).cast("string")
        head = (headers[i] if i < len(headers) else None) or f"Col{i + 1}"
        parts.append(F.when(stripped(text).isNotNull(), F.concat(F.lit(f"{head}="), text)))
    return F.concat_ws(", ", *parts)


def grouped_digits(c: Column) -> Column:
    return F.format_number(c, 0)


def cell_text(c: Column, kind: str | None, name: str = "") -> Column:
    """A result cell as text: Yes/No, a day, thousands separators, at most four decimals.

    kind None: an integer in a column named like a date and within 2000 to 2100 is a day; a float has four significant digits.
    """
    day = lambda x: F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd")
    trimmed = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if kind == "boolean":
        text = F.when(c.cast("boolean"), "Yes").otherwise("No")
    elif kind == "date":
        text = day(c)
    elif kind == "integer":
        text = grouped_digits(c)
    elif kind == "float":
        text = F.when(c == F.floor(c), grouped_digits(c)).otherwise(trimmed(F.format_number(F.round(c, 4), 4)))
    elif kind == "untyped_integer":
        text = F.when(F.lit("date" in name.lower()) & c.between(946_684_800, 4_102_444_800), day(c)).otherwise(grouped_digits(c))
    elif kind == "untyped_float":
        # four significant digits: round at the place that the size of the number gives
        places = F.lit(3) - F.floor(F.log10(F.abs(c))).cast("int")
        near = F.call_function("round", c * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places)
        text = F.when(c == F.floor(c), grouped_digits(c)).otherwise(trimmed(F.format_number(near, 8)))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))

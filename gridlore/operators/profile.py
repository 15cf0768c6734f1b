"""Statistics of each column of a table, one row a column."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions.filters import column, visible
from gridlore.shared import written

TOP_VALUES = 5
#: Rows that a task counts at a time; parts that a pass of rank selection makes of the values left, and the most values that the driver sorts in the end.
COUNTED, SPLITS, FEW_VALUES = 1 << 18, 1000, 500_000


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """c (place in names), l, d, s, n: how often each column has each value; whole numbers are in l, other numbers in d, all else as text in s (decimals in both), nulls in none.

    One scan for all columns: tasks count COUNTED rows at a time, column by column, and what they found is added up by (column, value).
    """
    slots, cells = [], []
    for i, name in enumerate(names):
        c, t = column(df, name), df.schema[name].dataType
        if isinstance(t, T.IntegralType):
            slots.append("l")
            cells.append(c.cast("bigint").alias(f"c{i}"))
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            slots.append("d")
            cells.append((c.cast("double") + F.lit(0.0)).alias(f"c{i}"))  # -0.0 and 0.0 are one value
        else:
            slots.append("s")
            cells.append(c.cast("string").alias(f"c{i}"))
    kinds = {"l": pa.int64(), "d": pa.float64(), "s": pa.string()}

    def count(batches):
        held: list[pa.RecordBatch] = []

        def made():
            rows = pa.Table.from_batches(held)
            held.clear()
            for i, slot in enumerate(slots):
                found = rows.column(i).cast(kinds[slot]).value_counts()
                n = len(found)
                values = {k: pa.nulls(n, t) for k, t in kinds.items()} | {slot: found.field("values")}
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int32()), *values.values(), found.field("counts")], ["c", "l", "d", "s", "n"])

        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= COUNTED:
                yield from made()
                size = 0
        if held:
            yield from made()

    found = df.select(*cells).mapInArrow(count, "c int, l bigint, d double, s string, n bigint").groupBy("c", "l", "d", "s").agg(F.sum("n").alias("n"))
    decimals = [i for i, name in enumerate(names) if isinstance(df.schema[name].dataType, T.DecimalType)]
    return found.withColumn("d", F.when(F.col("c").isin(decimals), F.col("s").try_cast("double")).otherwise(F.col("d"))) if decimals else found


def _buckets(rows: DataFrame, splits: dict[int, np.ndarray]) -> list:
    """g, bucket, n, values, low, high of rows (g, v, n): bucket i of group g holds the values from split i - 1 up to split i."""

    def count(batches):
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            g, v, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for one in np.unique(g):
                mine = g == one
                at, x, m = np.searchsorted(splits[one], v[mine], "right"), v[mine], n[mine]
                order = np.argsort(at, kind="stable")
                at, x, m = at[order], x[order], m[order]
                for place, first, past in zip(*np.unique(at, return_index=True), [*np.unique(at, return_index=True)[1][1:], len(at)], strict=True):
                    held = sums.setdefault((int(one), int(place)), [0, 0, np.inf, -np.inf])
                    part = np.sort(x[first:past])  # NaN comes last, as in Spark
                    low, high = float(part[0]), float(part[-1])
                    held[0] += int(m[first:past].sum())
                    held[1] += past - first
                    held[2] = low if np.isnan(held[2]) else min(held[2], low) if not np.isnan(low) else held[2]
                    held[3] = high if np.isnan(high) else held[3] if np.isnan(held[3]) else max(held[3], high)
        if sums:
            out = [(*k, *v) for k, v in sums.items()]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["g", "bucket", "n", "values", "low", "high"])

    found = rows.mapInArrow(count, "g int, bucket int, n bigint, values bigint, low double, high double")
    return found.groupBy("g", "bucket").agg(F.sum("n").alias("n"), F.sum("values").alias("values"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("g", "bucket").collect()


def ranked(values: DataFrame, ranks: dict[tuple[int, int], int], few: int | None = None, splits: int = SPLITS) -> dict[tuple[int, int], float]:
    """The value at each of ranks, (column, place from 0 in rising order) to the column's number of values: exact, over values (c, v, n; v not null).

    Where more than few values are left for a rank (without few, FEW_VALUES shared by all ranks), sketched quantiles of them make splits, one pass counts what is between, and only the bucket
    that holds the rank stays: each pass leaves about one in splits of the values. The driver gets counts by bucket, and at last few values a rank.
    """
    known: dict[tuple[int, int], float] = {}
    few = few or max(1, FEW_VALUES // len(ranks))
    left = {k: (None, None, 0, size) for k, size in ranks.items()}  # from, up to, rows before, values in between

    def grouped(keys: list) -> tuple[DataFrame, dict]:
        ranges = list(dict.fromkeys((k[0], *left[k][:2]) for k in keys))
        g = None
        for i, (c, low, high) in enumerate(ranges):
            inside = F.col("c") == c
            inside = inside & (F.col("v") >= low) if low is not None else inside
            inside = inside & (F.col("v") < high) if high is not None else inside
            g = F.when(inside, i) if g is None else g.when(inside, i)
        return values.select(g.cast("int").alias("g"), "v", "n").where("g is not null"), {k: ranges.index((k[0], *left[k][:2])) for k in keys}

    while wide := [k for k, x in left.items() if x[3] > few]:
        rows, group = grouped(wide)
        marks = [i / splits for i in range(1, splits)]
        cuts = {r["g"]: np.unique(np.array(r["q"], float)) for r in rows.groupBy("g").agg(F.percentile_approx("v", marks, 10 * splits).alias("q")).collect()}
        counted = _buckets(rows, cuts)
        for k in wide:
            before = left[k][2]
            for r in counted:
                if r["g"] != group[k]:
                    continue
                if before + r["n"] > k[1]:
                    at = cuts[r["g"]]
                    low = float(at[r["bucket"] - 1]) if r["bucket"] else left[k][0]
                    high = float(at[r["bucket"]]) if r["bucket"] < len(at) else left[k][1]
                    if r["low"] == r["high"] or np.isnan(r["low"]):
                        known[k] = r["low"]
                        del left[k]
                    else:
                        left[k] = (low, high, before, r["values"])
                    break
                before += r["n"]
    if left:
        rows, group = grouped(list(left))
        got = rows.toArrow()
        g, v, n = (got.column(k).to_numpy() for k in ("g", "v", "n"))
        order = np.lexsort((v, g))
        g, v, n = g[order], v[order], n[order]
        for k, (_, _, before, _) in left.items():
            mine = g == group[k]
            known[k] = float(v[mine][np.searchsorted(np.cumsum(n[mine]), k[1] - before, "right")])
    return known


def _exact(df: DataFrame, names: Sequence[str], counts: DataFrame) -> DataFrame:
    """The statistics of df's columns from their value_counts, a written table: a few passes over it, and some rows a column to the driver."""
    types = visible(df)
    v = F.coalesce("d", F.col("l").cast("double"))
    there = F.coalesce(v.isNotNull(), F.lit(False)) | F.col("s").isNotNull()
    ends = [f(F.col("l")).cast("string").alias(f"{a}_l") for a, f in (("lo", F.min), ("hi", F.max))] + [f(F.col("d")).alias(f"{a}_d") for a, f in (("lo", F.min), ("hi", F.max))]
    # decimals are ordered by their numbers and shown as their texts
    shown = [i for i, c in enumerate(names) if types[c] == "date" or isinstance(df.schema[c].dataType, T.DecimalType)]
    texts = {}
    if shown:
        both = [F.min("s").alias("lo_s"), F.max("s").alias("hi_s"), F.min_by("s", "d").alias("lo_x"), F.max_by("s", "d").alias("hi_x")]
        texts = {r["c"]: r.asDict() for r in counts.where(F.col("c").isin(shown)).groupBy("c").agg(*both).collect()}
    seen = counts.groupBy("c").agg(F.sum("n").alias("rows"), F.sum(F.when(there, F.col("n"))).alias("filled"), F.count(F.when(there, 1)).alias("values"), F.sum(v * F.col("n")).alias("total"), *ends).collect()
    of = {r["c"]: {"lo_s": None, "hi_s": None, "lo_x": None, "hi_x": None} | r.asDict() | texts.get(r["c"], {}) for r in seen}
    numbers = [i for i, c in enumerate(names) if types[c] in ("integer", "float") and of.get(i) and of[i]["filled"] and of[i]["total"] is not None]
    means = {i: of[i]["total"] / of[i]["filled"] for i in numbers}
    wide = counts.where(F.col("c").isin(numbers)).select("c", v.alias("v"), "n").where("v is not null")
    spread, middle = {}, {}
    if numbers:
        mean = F.element_at(F.create_map(*[F.lit(x) for kv in means.items() for x in kv]), F.col("c"))
        spread = {r["c"]: r["q"] for r in wide.groupBy("c").agg(F.sum(F.col("n") * (F.col("v") - mean) * (F.col("v") - mean)).alias("q")).collect()}
        middle = ranked(wide, {(i, at): of[i]["values"] for i in numbers for at in ((of[i]["filled"] - 1) // 2, of[i]["filled"] // 2)})
    rows = []
    for i, name in enumerate(names):
        r, t = of.get(i), df.schema[name].dataType
        rows_, filled = (r["rows"], r["filled"] or 0) if r else (0, 0)
        low = high = mean_ = median = std = None
        if r and types[name] in ("integer", "float", "date") and filled:
            low, high = (r["lo_l"], r["hi_l"]) if isinstance(t, T.IntegralType) else (r["lo_x"], r["hi_x"]) if isinstance(t, T.DecimalType) else (r["lo_s"], r["hi_s"]) if r["lo_d"] is None else (r["lo_d"], r["hi_d"])
        if i in means:
            mean_, n = means[i], filled
            median = (middle[i, (n - 1) // 2] + middle[i, n // 2]) / 2
            std = math.sqrt(spread[i] / (n - 1)) if n > 1 else None
        rows.append((name, types[name], rows_, rows_ - filled, (rows_ - filled) / rows_ if rows_ else 0.0, r["values"] if r else 0, *[(x, None) if isinstance(x, float) else (None, x) for x in (low, high)], mean_, median, std))
    end = "struct<d:double,s:string>"
    made = df.sparkSession.createDataFrame(rows, f"column_name string, logical_type string, row_count bigint, missing_count bigint, null_ratio double, distinct_count bigint, lo {end}, hi {end}, mean double, median double, std double")
    single = F.col("column_name").isin([c for c in names if isinstance(df.schema[c].dataType, T.FloatType)])
    text = lambda c: F.coalesce(F.when(single, F.col(f"{c}.d").cast("float").cast("string")).otherwise(F.col(f"{c}.d").cast("string")), F.col(f"{c}.s"))
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "median", "std")]
    return made.select("column_name", "logical_type", "row_count", "missing_count", F.round("null_ratio", 6).alias("null_ratio"), "distinct_count", text("lo").alias("min_value"), text("hi").alias("max_value"), *rounded)


def _sketched(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The statistics with distinct counts and medians from sketches, in one aggregate."""
    types = visible(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        c = column(df, name)
        aggs += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c, 0.01).alias(f"d{i}")]
        if types[name] in ("integer", "float", "date"):
            aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        if types[name] in ("integer", "float"):
            aggs += [F.avg(c).alias(f"avg{i}"), F.approx_percentile(c.cast("double"), 0.5, 10_000).cast("double").alias(f"med{i}"), F.stddev_samp(c).alias(f"std{i}")]
    one = df.agg(*aggs)
    rows = []
    none = F.lit(None).cast("double")
    for i, name in enumerate(names):
        ordered, number = types[name] in ("integer", "float", "date"), types[name] in ("integer", "float")
        rows.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(types[name]).alias("logical_type"), F.col("rows").alias("row_count"), (F.col("rows") - F.col(f"n{i}")).alias("missing_count"),
            F.round(F.when(F.col("rows") > 0, (F.col("rows") - F.col(f"n{i}")) / F.col("rows")).otherwise(0.0), 6).alias("null_ratio"), F.col(f"d{i}").alias("distinct_count"),
            (F.col(f"lo{i}") if ordered else F.lit(None).cast("string")).alias("min_value"), (F.col(f"hi{i}") if ordered else F.lit(None).cast("string")).alias("max_value"),
            (F.round(f"avg{i}", 4) if number else none).alias("mean"), (F.round(f"med{i}", 4) if number else none).alias("median"), (F.round(f"std{i}", 4) if number else none).alias("std"),
        ))
    return one.select(F.inline(F.array(*rows)))


def top_values(df: DataFrame, names: Sequence[str], n: int = TOP_VALUES) -> DataFrame:
    """column_name, value, count, rank of the n most frequent values of each column; ties in order of value.

    One unpivot for all columns; the count is folded before its shuffle and the rank keeps n rows a task.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), column(df, c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*").where("value is not null")
    return _top(long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")), n)


def top_of_counts(counts: DataFrame, names: Sequence[str], n: int = TOP_VALUES) -> DataFrame:
    """top_values of columns whose value_counts are there."""
    name = F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1)
    return _top(counts.where("s is not null").select(name.alias("column_name"), F.col("s").alias("value"), F.col("n").alias("count")), n)


def _top(counted: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("count"), "value"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n)


def profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Every visible column's statistics in order of name, with the top values of text and boolean columns as a map.

    Exact statistics come from one scan that counts each column's values (a table of its own), and medians by rank selection over these; dates are ordered as
    texts, so years 0 to 9999. approximate: distinct counts and medians from sketches of fixed size, for tables where the exact ones are too wide.
    """
    types = visible(df)
    names = sorted(columns or types)
    texts = [c for c in names if types[c] in ("string", "boolean")]
    if approximate:
        stats, tops = _sketched(df, names), top_values(df, texts) if texts else None
    else:
        counts = written(value_counts(df, names), "values")
        stats, tops = _exact(df, names, counts), top_of_counts(counts.where(F.col("c").isin([names.index(c) for c in texts])), names) if texts else None
    if tops is None:
        return stats.withColumn("top_values", F.lit(None).cast("map<string,bigint>")).orderBy("column_name")
    entry = F.struct("rank", "value", "count")
    tops = tops.groupBy("column_name").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    tops = tops.select("column_name", F.map_from_entries(F.transform("e", lambda x: F.struct(x["value"], x["count"]))).alias("top_values"))
    return stats.join(tops, "column_name", "left").orderBy("column_name")

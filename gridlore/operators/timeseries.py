"""Time columns, measures, gaps and linear-trend forecasts for many series in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gridlore.functions.cells import read_date
from gridlore.functions.filters import column, visible
from gridlore.operators.tables import number_in_blocks, with_offsets

FILL, WARN = 0.1, 0.3
TIME_SHARE, MEASURE_SHARE = 0.8, 0.5
HORIZON, BAND = 3, 1.96


def time_column(df: DataFrame) -> str | None:
    """The first date column by name, else the first text column of which more than 0.8 reads as dates; one pass over the text columns."""
    seen = visible(df)
    for name in sorted(seen):
        if seen[name] == "date":
            return name
    texts = [n for n in sorted(seen) if seen[n] == "string"]
    if not texts:
        return None
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(read_date(column(df, n))).alias(f"d{i}") for i, n in enumerate(texts)]).first()
    return next((n for i, n in enumerate(texts) if got["n"] and got[f"d{i}"] > TIME_SHARE * got["n"]), None)


def missing_policy(missing: Column) -> Column:
    return F.when(missing <= FILL, "forward_fill").when(missing <= WARN, "forward_fill_warned").otherwise("ineligible")


def measures(df: DataFrame, time: str) -> DataFrame:
    """name, missing_fraction, policy, eligible of each number column that has more than half its values."""
    seen = visible(df)
    names = [n for n in sorted(seen) if n != time and seen[n] in ("integer", "float")]
    schema = "name string, missing_fraction double, policy string, eligible boolean"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(column(df, n)).alias(f"n{i}") for i, n in enumerate(names)])
    shares = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(1.0) - F.try_divide(F.col(f"n{i}"), F.col("rows"))).alias("m")) for i, n in enumerate(names)])))
    kept = shares.where(F.lit(1.0) - F.col("m") > MEASURE_SHARE).withColumn("policy", missing_policy(F.col("m")))
    return kept.select("name", F.round("m", 4).alias("missing_fraction"), "policy", (F.col("policy") != "ineligible").alias("eligible"))


def sheet_record(df: DataFrame) -> DataFrame:
    """One row: time_column, measures (array of struct), eligible, reason."""
    spark, time = df.sparkSession, time_column(df)
    empty = "array<struct<name:string,missing_fraction:double,policy:string,eligible:boolean>>"
    if time is None:
        return spark.range(1).select(F.lit(None).cast("string").alias("time_column"), F.array().cast(empty).alias("measures"), F.lit(False).alias("eligible"), F.lit("no_time_column").alias("reason"))
    c = column(df, time)
    late = df.agg(F.coalesce(F.try_divide(F.count_if(c.isNull()), F.count(F.lit(1))), F.lit(1.0)).alias("time_missing"))
    listed = measures(df, time).agg(F.array_sort(F.collect_list(F.struct("name", "missing_fraction", "policy", "eligible"))).alias("found"))
    high = F.col("time_missing") > WARN
    any_ = F.exists("found", lambda m: m["eligible"])
    return late.join(F.broadcast(listed), F.lit(True)).select(
        F.lit(time).alias("time_column"), F.when(high, F.array().cast(empty)).otherwise(F.col("found")).alias("measures"), (~high & any_).alias("eligible"),
        F.when(high, "time_column_high_missing").when(~any_, "no_eligible_measure").alias("reason"),
    )


def _block(series: DataFrame, name: str) -> Column:
    """A value that never falls along name in order (nulls last) and is shared by few enough rows for one task: a minute, 32 dates, 4,096 numbers."""
    kind, c = series.schema[name].dataType.typeName(), F.col(name)
    if kind in ("string", "varchar", "char"):
        return F.coalesce(F.substring(c, 1, 7), F.lit("\U0010ffff"))
    if kind == "date":
        part = F.floor(F.unix_date(c) / 32)
    elif kind == "timestamp":
        part = F.floor(F.unix_seconds(c) / 60)
    elif kind == "timestamp_ntz":
        part = F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    elif isinstance(series.schema[name].dataType, NumericType):
        part = F.when(~F.isnan(c.cast("double")), F.floor(c.cast("double") / 4096))
    else:
        part = F.lit(0)
    return F.coalesce(part.cast("long"), F.lit(2**63 - 1))


def _in_blocks(series: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """series with its gaps filled, __x, the place of a row from 0, and __missing, the series' share of gaps.

    Only a block of a series is sorted by one task; blocks hand on their last value and count. Rows are dealt by blocks alone, never by series.
    """
    marked = series.withColumn("__block", _block(series, order[0]))
    at = F.when(F.col(value).isNotNull(), F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order]))
    ends = marked.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("gaps"), F.max_by(value, at).alias("last"), F.min_by(value, at).alias("first"))
    blocks = Window.partitionBy(*keys).orderBy("__block")
    past = blocks.rowsBetween(Window.unboundedPreceding, -1)
    # only the leading gap is filled from after, so the series' first value will do
    whole = blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead, missing = F.first("first", True).over(whole), F.sum("gaps").over(whole) / F.sum("n").over(whole)
    carried = ends.select(*keys, "__block", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("__before"), F.last("last", True).over(past).alias("__past"), lead.alias("__lead"), missing.alias("__missing"))
    w = Window.partitionBy(*keys, "__block").orderBy(*[F.asc_nulls_last(c) for c in order])
    own = marked.withColumns({"__own": F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__place": F.row_number().over(w)})
    joined = with_offsets(own, carried, keys)
    return joined.withColumns({value: F.coalesce("__own", "__past", "__lead"), "__x": F.col("__place") - 1 + F.col("__before")}).select(*series.columns, "__x", "__missing")


def filled(series: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """value with gaps filled from before, then from after."""
    return _in_blocks(series, keys, order, value).drop("__x", "__missing")


def indexed(series: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "i") -> DataFrame:
    """series with the place of each row in its series, from 0."""
    return number_in_blocks(series, keys, [F.asc_nulls_last(c) for c in order], _block(series, order[0]), name)


def forecast(series: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", horizon: int = HORIZON) -> DataFrame:
    """keys, n, horizon, point, lower, upper (arrays), backtest_std, missing_fraction, policy: a straight line through each series.

    Series are in time order; their gaps are filled by policy and series with too many left out, as are those of fewer
    than two points. The line is fitted on the index 0 to n-1; the band is 1.96 population deviations of the residuals.
    """
    placed = _in_blocks(series, keys, order, value).withColumnRenamed("__missing", "missing").withColumn("policy", missing_policy(F.col("missing")))
    gap_free = placed.where((F.col("policy") != "ineligible") & F.col(value).isNotNull())
    y = F.col(value).cast("double")
    fit = gap_free.withColumn("x", F.col("__x").cast("double")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, F.col("x")).alias("slope"), F.regr_intercept(y, F.col("x")).alias("intercept"),
        F.sqrt(F.greatest(F.lit(0.0), F.regr_syy(y, F.col("x")) - F.try_divide(F.pow(F.regr_sxy(y, F.col("x")), 2), F.regr_sxx(y, F.col("x")))) / F.count(F.lit(1))).alias("std"),
        F.first("missing").alias("missing"), F.first("policy").alias("policy"),
    ).where("n >= 2")
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    at = lambda k, sign: F.round(F.col("intercept") + F.col("slope") * (F.col("n") + k) + sign * BAND * F.col("std"), 4)
    return fit.select(
        *keys, "n", F.lit(horizon).alias("horizon"), F.transform(steps, lambda k: at(k, 0)).alias("point"), F.transform(steps, lambda k: at(k, -1)).alias("lower"), F.transform(steps, lambda k: at(k, 1)).alias("upper"),
        F.round("std", 4).alias("backtest_std"), F.round("missing", 4).alias("missing_fraction"), "policy",
    )


def sheet_forecasts(df: DataFrame, time: str, names: Sequence[str], tie: Sequence[str] = (), horizon: int = HORIZON) -> DataFrame:
    """A forecast for each named measure of a table, in one job: measures unpivoted, sorted by time, filled, fitted."""
    long = df.select(column(df, time).alias("t"), *[F.col(c) for c in tie], F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), column(df, n).cast("double").alias("value")) for n in names])).alias("m"))
    return forecast(long.select("t", *tie, "m.measure", "m.value"), ["measure"], ["t", *tie], horizon=horizon)


def forecast_artifacts(forecasts: DataFrame, document_id: str, sheet: str, time: str, version: str = "1") -> DataFrame:
    """Rows to append to the table of forecasts: a fresh id, the time, and the forecast as JSON."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(["point", "lower", "upper", "horizon", "backtest_std"])]))
    return forecasts.select(F.expr("uuid()").alias("artifact_id"), F.lit(document_id).alias("document_id"), F.lit(sheet).alias("sheet_name"), F.col("measure").alias("measure_column"), F.lit(time).alias("time_column"), body.alias("forecast_json"), F.lit(version).alias("pipeline_version"), F.current_timestamp().alias("generated_at"))


def newest_forecast(artifacts: DataFrame, documents: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row: the newest artifact of the ids with its file name; without one, a row with the reason alone."""
    one = artifacts.where(F.col("document_id").isin(list(ids)) if ids else F.lit(False)).orderBy(F.desc("generated_at"), "artifact_id").limit(1)
    named = one.join(documents.select("document_id", "filename"), "document_id", "left")
    base = artifacts.sparkSession.range(1).select(F.lit(0).alias("k"))
    return base.join(named.withColumn("k", F.lit(0)), "k", "left").drop("k").withColumn("reason", F.when(F.col("artifact_id").isNull(), "no_forecast_available"))


def chart_points(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, step (1 on), x (H1 on), forecast, lower, upper."""
    zipped = forecasts.select(*keys, F.posexplode(F.arrays_zip("point", "lower", "upper")).alias("pos", "z"))
    return zipped.select(*keys, (F.col("pos") + 1).alias("step"), F.concat(F.lit("H"), (F.col("pos") + 1).cast("string")).alias("x"), F.col("z.point").alias("forecast"), F.col("z.lower").alias("lower"), F.col("z.upper").alias("upper"))


def merged_series(points: DataFrame, series: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """Long points (step, x, series, value) to one wide row for each x, in order of step."""
    return points.groupBy("step", "x").pivot(series, list(names)).agg(F.first(value)).orderBy("step")

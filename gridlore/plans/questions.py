"""Queries of profiles, series, retrieval, the archive, freshness and question logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.functions import intents, texts
from gridlore.operators import archive, freshness, retrieval, timeseries
from gridlore.operators.profile import profile, top_values
from gridlore.operators.trigrams import TextIndex
from gridlore.shared import shared_path, written

from .data import CHUNKS_SQL, DOCS_SQL, HISTORY_SQL, chunks, collapsed_sql, documents, history, order_lines, pages_archive, stripped_sql
from .registry import SQL, over, query, register, table

# PR, W9: profiles

_LINE = ("l_quantity", "l_discount", "l_orderkey")


def _profile_sql(source: str, columns: tuple[str, ...]) -> str:
    one = "select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as missing_count, round((count(*) - count({c}))::double / count(*), 6) as null_ratio, count(distinct {c}) as distinct_count, min({c})::double as lowest, max({c})::double as highest, round(avg({c}), 4) as mean, round(median({c})::double, 4) as median, round(stddev_samp({c}), 4) as std from " + source
    return " union all ".join(one.format(c=c) for c in columns)


def _numbers(d: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    p = profile(d, columns)
    return p.select("column_name", "row_count", "missing_count", "null_ratio", "distinct_count", F.col("min_value").cast("double").alias("lowest"), F.col("max_value").cast("double").alias("highest"), "mean", "median", "std")


over("pr1_to_pr4_numbers", "lineitem", lambda d: _numbers(d, _LINE), _profile_sql("lineitem", _LINE))
over("pr1_nulled", "orders", lambda d: _numbers(d.select(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price")), ("price",)), _profile_sql("(select case when o_orderstatus <> 'F' then o_totalprice end as price from orders)", ("price",)))
over(
    "pr5_top_values", "customer", lambda d: top_values(d, ["c_mktsegment", "c_nationkey"]),
    "select * from (select column_name, value, count, row_number() over (partition by column_name order by count desc, value)::int as rank from (select 'c_mktsegment' as column_name, c_mktsegment as value, count(*) as count from customer group by 2 union all select 'c_nationkey', c_nationkey::varchar, count(*) from customer group by 2)) where rank <= 5",
)
over("w09_top_values", "events", lambda d: top_values(d, ["event_type"]).select("value", "count"), "select event_type as value, count(*) as count from events group by 1 order by 2 desc, 1 limit 5")
over("pr6_profile", "lineitem", profile)
_TEXT = "column_name, logical_type, row_count, missing_count, null_ratio, distinct_count, min_value, max_value, mean, median, std, top_values"
_TYPES = {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "date"}


def _whole_profile_sql() -> str:
    one = []
    for c, kind in _TYPES.items():
        number, ordered, text = kind in ("integer", "float"), kind != "string", kind == "string"
        tops = f"(select string_agg(v || '=' || n, ',' order by n desc, v) from (select {c} as v, count(*) as n from lineitem group by 1 order by 2 desc, 1 limit 5))" if text else "null::varchar"
        values = [f"round({x}, 4)" if number else "null::double" for x in (f"avg({c})", f"median({c})::double", f"stddev_samp({c})")]
        ends = [f"{f}({c})::varchar" if ordered else "null::varchar" for f in ("min", "max")]
        one.append(f"select '{c}' as column_name, '{kind}' as logical_type, count(*) as row_count, count(*) - count({c}) as missing_count, round((count(*) - count({c}))::double / count(*), 6) as null_ratio, count(distinct {c}) as distinct_count, {ends[0]} as min_value, {ends[1]} as max_value, {values[0]} as mean, {values[1]} as median, {values[2]} as std, {tops} as top_values from lineitem")
    return " union all ".join(one)


over(
    "pr6_profile_texts", "lineitem",
    lambda d: profile(d).withColumn("top_values", F.array_join(F.transform(F.array_sort(F.transform(F.map_entries("top_values"), lambda x: F.struct((-x["value"]).alias("n"), x["key"].alias("v")))), lambda x: F.concat(x["v"], F.lit("="), (-x["n"]).cast("string"))), ",")).select(*_TEXT.split(", ")),
    _whole_profile_sql(),
)
over("pr6_profile_approximate", "lineitem", lambda d: profile(d, approximate=True))

# X, W2 to W4: series

_DAILY = "e as (select event_type, date_trunc('day', ts)::date as day, sum(value) as v from events group by 1, 2), y as (select event_type, day, case when extract(day from day) % 10 = 3 then null else v end as value from e)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of values by event type, with gaps on the days of the month that end in 3."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return e.select("event_type", "day", F.when(F.dayofmonth("day") % 10 != 3, F.col("v")).alias("value"))


@query("with " + _DAILY + " select event_type, day, round(coalesce(last_value(value ignore nulls) over (partition by event_type order by day rows between unbounded preceding and current row), first_value(value ignore nulls) over (partition by event_type order by day rows between current row and unbounded following)), 4) as value from y")
def w02_w03_filled(spark, sf_dir):
    return timeseries.filled(daily(spark, sf_dir), ["event_type"], ["day"]).withColumn("value", F.round("value", 4))


register(
    "w04_index", lambda s, d: timeseries.indexed(daily(s, d), ["event_type"], ["day"]).select("event_type", "day", F.col("i").cast("int")),
    "with " + _DAILY + " select event_type, day, (row_number() over (partition by event_type order by day) - 1)::int as i from y",
)

@query("select case when avg((o_orderstatus = 'F')::int) > 0.8 then 'a_when' when avg((o_orderstatus <> 'P')::int) > 0.8 then 'b_when' end as time_column from orders")
def x01_time_column(spark, sf_dir):
    """A table without a date column: texts of which a share reads as dates."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", day).otherwise("n/a").alias("a_when"), F.when(F.col("o_orderstatus") != "P", day).otherwise("n/a").alias("b_when"))
    return spark.createDataFrame([(timeseries.time_column(d),)], "time_column string")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with gaps: taxes of returned ones, discounts of those not N."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity", F.when(flag != "R", F.col("l_tax")).alias("l_tax"), F.when(flag == "N", F.col("l_discount")).alias("l_discount"))


_GAPPY = "g as (select unnest(['l_discount', 'l_quantity', 'l_tax']) as name, unnest([avg((l_returnflag <> 'N')::int), 0.0, avg((l_returnflag = 'R')::int)]) as m from lineitem)"


@query(f"with {_GAPPY} select name, round(m, 4) as missing_fraction, case when m <= 0.1 then 'forward_fill' when m <= 0.3 then 'forward_fill_warned' else 'ineligible' end as policy, m <= 0.3 as eligible from g where 1 - m > 0.5")
def x02_measures(spark, sf_dir):
    return timeseries.measures(gappy(spark, sf_dir), "l_shipdate")


@query("with " + _DAILY + ", m as (select event_type, avg((value is null)::int) as missing from y group by 1) select event_type, round(missing, 6) as missing, case when missing <= 0.1 then 'forward_fill' when missing <= 0.3 then 'forward_fill_warned' else 'ineligible' end as policy from m")
def x03_missing_policy(spark, sf_dir):
    m = daily(spark, sf_dir).groupBy("event_type").agg((F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("missing"))
    return m.select("event_type", F.round("missing", 6).alias("missing"), timeseries.missing_policy(F.col("missing")).alias("policy"))


@query(f"with {_GAPPY} select 'l_shipdate' as time_column, count_if(1 - m > 0.5)::int as n_measures, count_if(1 - m > 0.5 and m <= 0.3) > 0 as eligible, case when count_if(1 - m > 0.5 and m <= 0.3) = 0 then 'no_eligible_measure' end as reason from g")
def x04_sheet_record(spark, sf_dir):
    return timeseries.sheet_record(gappy(spark, sf_dir)).select("time_column", F.size("measures").alias("n_measures"), "eligible", "reason")


_FIT = _DAILY + """, g as (select event_type, day, coalesce(last_value(value ignore nulls) over (partition by event_type order by day rows between unbounded preceding and current row), first_value(value ignore nulls) over (partition by event_type order by day rows between current row and unbounded following)) as value from y),
  i as (select event_type, value, row_number() over (partition by event_type order by day) - 1 as x from g),
  f as (select event_type, count(*) as n, regr_slope(value, x) as a, regr_intercept(value, x) as b, sqrt(greatest(0, regr_syy(value, x) - regr_sxy(value, x) * regr_sxy(value, x) / regr_sxx(value, x)) / count(*)) as s from i group by 1),
  k as (select event_type, n, s, h, b + a * (n + h) as p from f, (values (0), (1), (2)) t(h))"""


@query("with " + _FIT + " select event_type, n, (h + 1)::int as step, 'H' || (h + 1) as x, round(round(p, 4), 2) as forecast, round(round(p - 1.96 * s, 4), 2) as lower, round(round(p + 1.96 * s, 4), 2) as upper from k")
def x05_x08_forecast_points(spark, sf_dir):
    f = timeseries.forecast(daily(spark, sf_dir), ["event_type"], ["day"])
    return timeseries.chart_points(f, ["event_type", "n"]).withColumns({c: F.round(c, 2) for c in ("forecast", "lower", "upper")})


@query("with " + _FIT + " select (h + 1)::int as step, 'H' || (h + 1) as x, max(case when event_type = 'click' then round(round(p, 4), 2) end) as click, max(case when event_type = 'purchase' then round(round(p, 4), 2) end) as purchase from k group by 1, 2")
def x09_merged_series(spark, sf_dir):
    points = timeseries.chart_points(timeseries.forecast(daily(spark, sf_dir), ["event_type"], ["day"]), ["event_type"])
    return timeseries.merged_series(points.select("step", "x", "event_type", F.round("forecast", 2).alias("value")), "event_type", ["click", "purchase"])


@query()
def x06_sheet_forecasts(spark, sf_dir):
    return timeseries.sheet_forecasts(table(spark, sf_dir, "events"), "ts", ["value", "user_id"], ["event_id"])


_SHEET_FIT = """e as (select ts, event_id, unnest(['kept', 'user_id', 'value']) as measure, unnest([case when event_id % 7 > 0 then value end, user_id::double, value]) as v from events),
  g as (select measure, coalesce(last_value(v ignore nulls) over (w rows between unbounded preceding and current row), first_value(v ignore nulls) over (w rows between current row and unbounded following)) as v, row_number() over w - 1 as x, v is null as gap from e window w as (partition by measure order by ts, event_id)),
  f as (select measure, count(*) as n, avg(gap::int) as missing, regr_slope(v, x) as a, regr_intercept(v, x) as b, sqrt(greatest(0, regr_syy(v, x) - regr_sxy(v, x) * regr_sxy(v, x) / regr_sxx(v, x)) / count(*)) as s from g group by 1),
  k as (select measure, n, h, s, b + a * (n + h) as p, case when missing <= 0.1 then 'forward_fill' else 'forward_fill_warned' end as policy from f, (values (0), (1), (2)) t(h))"""


def gappy_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of three measures of events, one with a gap in every seventh row."""
    e = table(spark, sf_dir, "events").withColumn("kept", F.when(F.col("event_id") % 7 > 0, F.col("value")))
    return timeseries.sheet_forecasts(e, "ts", ["value", "user_id", "kept"], ["event_id"])


@query("with " + _SHEET_FIT + " select measure, n, policy, (h + 1)::int as step, 'H' || (h + 1) as x, round(round(p, 4), 2) as forecast, round(round(p - 1.96 * s, 4), 2) as lower, round(round(p + 1.96 * s, 4), 2) as upper from k")
def x06_forecast_points(spark, sf_dir):
    points = timeseries.chart_points(gappy_forecasts(spark, sf_dir), ["measure", "n", "policy"])
    return points.withColumns({c: F.round(c, 2) for c in ("forecast", "lower", "upper")})


@query("with " + _SHEET_FIT + " select '1' as document_id, 'events' as sheet_name, measure as measure_column, 'ts' as time_column, 3 as horizon, h::int as step, round(round(p, 4), 2) as point, round(round(s, 4), 2) as spread from k")
def s14_artifacts_read_back(spark, sf_dir):
    """What the artifacts' JSON holds, without their ids and times."""
    made = timeseries.forecast_artifacts(gappy_forecasts(spark, sf_dir), "1", "events", "ts")
    body = F.from_json("forecast_json", "horizon int, point array<double>, backtest_std double")
    read = made.select("document_id", "sheet_name", "measure_column", "time_column", body.alias("b"))
    return read.select("document_id", "sheet_name", "measure_column", "time_column", "b.horizon", F.posexplode("b.point").alias("step", "p"), F.round("b.backtest_std", 2).alias("spread")).select("document_id", "sheet_name", "measure_column", "time_column", "horizon", "step", F.round("p", 2).alias("point"), "spread")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.forecast_artifacts(x06_sheet_forecasts(spark, sf_dir), "1", "events", "ts")


register("s14_forecast_artifacts", artifacts)
register("s19_artifacts_newest_first", lambda s, d: artifacts(s, d).where(F.col("document_id").isin("1")).orderBy(F.desc("generated_at"), "artifact_id"))
register("x07_newest_forecast", lambda s, d: timeseries.newest_forecast(artifacts(s, d), documents(s, d), ["1"]).drop("artifact_id", "generated_at"))
register("x07_no_forecast", lambda s, d: timeseries.newest_forecast(artifacts(s, d), documents(s, d), []).select("reason"), "select 'no_forecast_available' as reason")



def stamped_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast artifact a turn of the conversations, with fixed ids and times."""
    at = F.expr("timestamp_ntz '2024-03-01' + make_dt_interval(0, 0, cast(conv_id * 7 % 50 + turn as int), 0)")
    c, text = table(spark, sf_dir, "conversations"), lambda c: F.col(c).cast("string")
    return c.select(F.md5(F.concat_ws(":", text("conv_id"), text("turn"))).alias("artifact_id"), (F.col("conv_id") % 9).cast("string").alias("document_id"), F.col("role").alias("measure_column"), at.alias("generated_at"))


@query("with " + DOCS_SQL + """, a as (select md5(conv_id || ':' || turn) as artifact_id, (conv_id % 9)::varchar as document_id, role as measure_column, timestamp '2024-03-01' + to_minutes((conv_id * 7 % 50 + turn)::int) as generated_at from conversations)
    select artifact_id, document_id, measure_column, generated_at, filename, null::varchar as reason from (select * from a where document_id in ('1', '4') order by generated_at desc, artifact_id limit 1) left join d using (document_id)""")
def x07_newest_of_scope(spark, sf_dir):
    found = timeseries.newest_forecast(stamped_artifacts(spark, sf_dir), documents(spark, sf_dir), ["1", "4"])
    return found.select("artifact_id", "document_id", "measure_column", "generated_at", "filename", "reason")


# R, W5 to W8, U: retrieval


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))


def _terms(t: str) -> str:
    from gridlore.functions.texts import STOP_WORDS

    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(string_split({collapsed_sql(f'lower({t})')}, ' '), lambda x: length(x) > 2 and x not in ({words}))[1:10]"


@query(
    "with " + DOCS_SQL + ", " + CHUNKS_SQL + " select chunk_id from c join d using (document_id) where status = 'ready' and (contains(lower(content), 'licensed') or contains(lower(content), 'token')) order by chunk_index, chunk_id limit 20"
)
def r01_keyword_search(spark, sf_dir):
    return retrieval.keyword_search(chunks(spark, sf_dir), documents(spark, sf_dir), "What is the licensed token?".replace("?", "")).select("chunk_id")


@query("with " + CHUNKS_SQL + ", q as (select item_id as question_id, unnest(" + _terms("text") + ") as term from benchmark), h as (select distinct question_id, chunk_id, chunk_index from q, c where contains(lower(content), term)) select question_id, chunk_id, row_number() over (partition by question_id order by chunk_index, chunk_id)::int as rank from h qualify row_number() over (partition by question_id order by chunk_index, chunk_id) <= 20")
def r01_keyword_search_batch(spark, sf_dir):
    return retrieval.keyword_search_batch(chunks(spark, sf_dir), asked(spark, sf_dir))


@query("with " + DOCS_SQL + ", " + CHUNKS_SQL + " select chunk_id from c join d using (document_id) where status = 'ready' and contains(lower(content), '555-') order by chunk_index, chunk_id limit 5")
def r02_term_search(spark, sf_dir):
    return retrieval.term_search(chunks(spark, sf_dir), documents(spark, sf_dir), ["555-"]).select("chunk_id")


@query("with " + DOCS_SQL + ", " + CHUNKS_SQL + " select chunk_id from c join d using (document_id) where status = 'ready' and contains(lower(filename), 'src1-de') order by chunk_index desc, chunk_id limit 3")
def r03_w08_last_of_file(spark, sf_dir):
    return retrieval.file_search(chunks(spark, sf_dir), documents(spark, sf_dir), "src1-DE", 3, last=True).select("chunk_id")


@query("with " + CHUNKS_SQL + " select chunk_id from c order by chunk_index, chunk_id limit 10")
def t06_first_chunks(spark, sf_dir):
    return retrieval.first_chunks(chunks(spark, sf_dir), 10).select("chunk_id")


_PAGE = "with " + HISTORY_SQL + " select url_hash, url, case when length(content) > 200 then substr(content, 1, 200) || '...' else content end as excerpt, timestamp from p "


@query(_PAGE + "where url ilike '%token%' or content ilike '%token%' order by timestamp desc, url_hash limit 21")
def r04_archive_search(spark, sf_dir):
    return archive.search_pages(pages_archive(spark, sf_dir), "token")


@query(_PAGE + "where timestamp < timestamp '2024-01-01 05:00:00' order by timestamp desc, url_hash limit 6")
def t04_page_after_cursor(spark, sf_dir):
    return archive.search_pages(pages_archive(spark, sf_dir), limit=5, cursor=("2024-01-01 05:00:00", "g"))


@query("with " + HISTORY_SQL + " select count(*) as total from p where url ilike '%token%' or content ilike '%token%'")
def a10_archive_count(spark, sf_dir):
    return archive.count_pages(pages_archive(spark, sf_dir), "token")


def archive_index(spark: SparkSession, sf_dir: str):
    return archive.page_index(shared_path(spark, "page-index"), 16).build(pages_archive(spark, sf_dir))


@query(SQL["r04_archive_search"])
def r04_indexed_search(spark, sf_dir):
    """The search through a trigram index that is built first."""
    return archive.search_pages(archive.candidate_pages(spark, archive_index(spark, sf_dir), "token"), "token")


@query(SQL["a10_archive_count"])
def a10_indexed_count(spark, sf_dir):
    return archive.count_pages(archive.candidate_pages(spark, archive_index(spark, sf_dir), "token"), "token")


@query(SQL["r01_keyword_search"])
def r01_indexed_search(spark, sf_dir):
    found = TextIndex(shared_path(spark, "chunk-index"), "chunk_id", ("content",), 16).build(chunks(spark, sf_dir))
    return retrieval.keyword_search(found.candidates(spark, ["licensed", "token"]), documents(spark, sf_dir), "What is the licensed token").select("chunk_id")


@query("with " + HISTORY_SQL + " select distinct p.url, p.content, p.timestamp from p join h using (url_hash) where contains(h.query, 'that the') or contains(lower(p.content), 'that the') order by p.timestamp desc, p.url limit 3")
def r05_j03_recall(spark, sf_dir):
    return archive.recall(pages_archive(spark, sf_dir), history(spark, sf_dir), " That the ")


@query(SQL["r05_j03_recall"])
def r05_indexed_recall(spark, sf_dir):
    h = history(spark, sf_dir)
    return archive.recall(archive.recall_candidates(spark, archive_index(spark, sf_dir), h, " That the "), h, " That the ")


@query("with a as (select lower(S) as key, role as answer from conversations qualify row_number() over (partition by lower(S) order by conv_id * 10 + turn desc, role) = 1), q as (select conv_id * 10 + turn as question_id, text as query from conversations union all select -1 - item_id, text from benchmark) select question_id, query, answer from q left join a on lower(Q) = key".replace("S)", stripped_sql("text") + ")").replace("Q)", stripped_sql("query") + ")"))
def r06_cached_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("question_id", F.col("conv_id") * 10 + F.col("turn"))
    answers = c.select(texts.normal_query(F.col("text")).alias("query"), F.col("role").alias("answer"), F.col("question_id").alias("timestamp"))
    questions = c.select("question_id", F.col("text").alias("query")).unionByName(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("question_id"), F.col("text").alias("query")))
    return archive.cached_answers(answers, questions)


_VEC = "select q.vec_id as question_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score from embeddings e, embeddings q where q.vec_id % 50 = 0"


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))


@query(f"with s as ({_VEC}) select question_id, vec_id, round(score, 6) as score, row_number() over (partition by question_id order by score desc, vec_id)::int as rank from s qualify row_number() over (partition by question_id order by score desc, vec_id) <= 3")
def r07_semantic_search(spark, sf_dir):
    found = retrieval.semantic_search(table(spark, sf_dir, "embeddings"), vector_questions(spark, sf_dir), 3)
    return found.select("question_id", "vec_id", "score", "rank")


@query(f"with s as ({_VEC} and e.label in (1, 2)) select question_id, vec_id, round(score, 6) as score, row_number() over (partition by question_id order by score desc, vec_id)::int as rank from s qualify row_number() over (partition by question_id order by score desc, vec_id) <= 12")
def r08_u03_semantic_search_in_scope(spark, sf_dir):
    found = retrieval.semantic_search(table(spark, sf_dir, "embeddings"), vector_questions(spark, sf_dir), 12, F.col("label").isin(1, 2))
    return found.select("question_id", "vec_id", "score", "rank")


@query(SQL["r08_u03_semantic_search_in_scope"])
def u03_merged_top_k(spark, sf_dir):
    """The best of each label by itself, merged and cut again."""
    e, q = table(spark, sf_dir, "embeddings"), vector_questions(spark, sf_dir)
    return retrieval.merged_top([retrieval.semantic_search(e, q, 12, F.col("label") == n, whole=True) for n in (1, 2)], 12).select("question_id", "vec_id", "score", "rank")


@query("select item_id as question_id, case when item_id % 2 = 0 then 'doc://' || item_id else 'local://weights' end as url, case when item_id % 2 = 0 then text else 'Answer from model knowledge.' end as text from benchmark")
def r11_fallback_contexts(spark, sf_dir):
    """Every second question has a context."""
    q = asked(spark, sf_dir)
    found = q.where("question_id % 2 = 0").select("question_id", F.concat(F.lit("doc://"), F.col("question_id").cast("string")).alias("url"), F.col("query").alias("text"))
    return retrieval.with_fallback(q, found)


def row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.operators.chunking import chunk_rows_by_budget

    c = chunk_rows_by_budget(order_lines(spark, sf_dir).withColumn("document_id", F.col("sheet_name")))
    none = F.lit(None)
    return written(c.withColumn("meta", F.struct(none.cast("int").alias("page"), F.col("sheet_name").alias("sheet"), "row_start", "row_end")), "row-chunks")


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about the orders, made from the nations: rows, column values, files and plain words."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string")
    text = F.element_at(
        F.array(F.concat(F.lit("what is in row "), k), F.concat(F.lit("who has "), k, F.lit(" in the o_orderkey column")), F.lit("show the last row from the 5-LOW file"), F.concat(F.lit("orders with o_orderstatus=P of "), F.lower("n_name"))),
        (F.col("n_nationkey") % 4 + 1).cast("int"),
    )
    return n.select(F.col("n_nationkey").cast("bigint").alias("question_id"), text.alias("query"))


def order_files(chunked: DataFrame) -> DataFrame:
    return chunked.select("document_id").distinct().select("document_id", F.concat("document_id", F.lit(".csv")).alias("filename"), F.lit("ready").alias("status"))


@query()
def r09_u01_t05_p23_hybrid_search(spark, sf_dir):
    c = row_chunks(spark, sf_dir)
    return retrieval.hybrid_search(c, order_files(c), question_log(spark, sf_dir))


def _found_sql(table_: str, key: str, text: str) -> str:
    """The first 20 rows of a table, by id, that hold one of a question's terms."""
    return f"(select question_id, {key}, pos from (select question_id, {key}, row_number() over (partition by question_id order by {key}, {key}::varchar) as pos from (select distinct question_id, {key} from t, {table_} where contains(lower({text}), term))) where pos <= 20)"


@query(
    f"""with recursive t as materialized (select item_id as question_id, unnest({_terms('text')}) as term from benchmark),
    w as materialized (select question_id, pos, url, substr(html, 1, 2000) as text from {_found_sql('pages', 'page_id', 'html')} join pages using (page_id)),
    f as (select question_id, pos, case when length(text) <= 5600 then length(text) else 0 end as used, length(text) <= 5600 as took from w where pos = 1
        union all select w.question_id, w.pos, case when f.used + length(text) <= 5600 then f.used + length(text) else f.used end, f.used + length(text) <= 5600 from f join w on w.question_id = f.question_id and w.pos = f.pos + 1),
    u as (select question_id, max(used) as used from f group by 1),
    d as (select question_id, pos, doc_id, text, 14000 - coalesce(used, 0) - coalesce(sum(length(text)) over (partition by question_id order by pos rows between unbounded preceding and 1 preceding), 0) as room from {_found_sql('documents', 'doc_id', 'text')} join documents using (doc_id) left join u using (question_id))
    select question_id, 0 as source, pos::int as pos, url, text from w join f using (question_id, pos) where took union all
    select question_id, 1, pos::int, 'doc://' || doc_id, substr(text, 1, least(length(text), room)::int) from d where room >= 200"""
)
def r10_w06_u04_budget(spark, sf_dir):
    """Web items: the pages that hold one of a question's terms, the first 20 by id; documents likewise."""
    q, d, p = asked(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    docs = d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"))
    web = p.select(F.col("page_id").cast("string").alias("chunk_id"), F.col("page_id").alias("chunk_index"), F.col("html").alias("content"), "url")
    found = lambda rows: retrieval.keyword_search_batch(rows.drop("url"), q).join(rows, "chunk_id").select("question_id", F.col("rank").alias("pos"), "url", F.col("content").alias("text"))
    return retrieval.allocate_budget(found(web), found(docs))


@query(
    f"""with {DOCS_SQL}, q as (select vec_id as question_id, embedding::double[] as v, 'which licensed token ' || label as query from embeddings where vec_id % 50 = 0),
    b as (select d.document_id as chunk_id, doc_id as chunk_index, filename, text from documents join d on d.document_id = doc_id::varchar where status = 'ready'),
    n as (select question_id, chunk_id, 3 as branch, row_number() over (partition by question_id order by s desc, chunk_id) as r from (select question_id, chunk_id, list_cosine_similarity(embedding::double[], v) as s from q, embeddings e join b on b.chunk_id = e.vec_id::varchar) qualify r <= 12),
    k as (select question_id, chunk_id, 4 as branch, row_number() over (partition by question_id order by chunk_index, chunk_id) as r from q, b where contains(lower(text), 'licensed') or contains(lower(text), 'token') qualify r <= 20),
    m as (select * from (select * from n union all select * from k) qualify row_number() over (partition by question_id, chunk_id order by branch) = 1)
    select question_id, row_number() over (partition by question_id order by branch, r, chunk_id)::int as pos, chunk_id, 'doc://' || chunk_id as url, '[' || filename || '] ' || chr(10) || text as text, branch = 3 as semantic from m join b using (chunk_id)"""
)
def r09_u01_t05_semantic_hybrid(spark, sf_dir):
    """Whole documents as chunks, with the vectors of the same ids; questions with a vector and words. Some chunks come from the semantic branch alone."""
    none = F.lit(None)
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    meta = F.struct(none.cast("int").alias("page"), none.cast("string").alias("sheet"), none.cast("bigint").alias("row_start"), none.cast("bigint").alias("row_end"))
    c = d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"), meta.alias("meta"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.concat(F.lit("which licensed token "), F.col("label").cast("string")).alias("query"), F.col("embedding").alias("vector"))
    vectors = e.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return retrieval.hybrid_search(c, documents(spark, sf_dir), q, vectors=vectors, with_branch=True).select("question_id", "pos", "chunk_id", "url", "text", (F.col("branch") == "semantic").alias("semantic"))


@query("with i as (select source as question_id, doc_id as pos, text, coalesce(sum(length(text)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as used from documents) select question_id, pos, substr(text, 1, least(length(text), 14000 - used)::int) as text from i where 14000 - used >= 200")
def w05_document_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("question_id"), F.col("doc_id").alias("pos"), "text")
    return retrieval.fit_documents(d, F.lit(retrieval.TOTAL_BUDGET))


@query("with " + CHUNKS_SQL + " select document_id, content, row_number() over (partition by document_id order by chunk_index desc)::int - 1 as chunk_index from c")
def w07_ordinals(spark, sf_dir):
    from gridlore.operators.chunking import number_chunks

    return number_chunks(chunks(spark, sf_dir).withColumn("pos", -F.col("chunk_index")), ["pos"]).select("document_id", "content", "chunk_index")


@query(
    """with n as (select conv_id, max(case when role = 'system' then 'OFFLINE' when turn > 4 then 'ONLINE' end) as prefer, count_if(role = 'user')::bigint > 2 as web, (max(turn) % 3)::bigint as online, (max(turn) % 2)::bigint as archived, (conv_id % 2)::bigint as docs from conversations group by conv_id),
    w as (select *, case when prefer = 'OFFLINE' then case when archived > 0 then 'OFFLINE_ARCHIVE' end when web and online > 0 then 'ONLINE' when web and coalesce(prefer, '') <> 'ONLINE' and archived > 0 then 'OFFLINE_ARCHIVE' end as m from n)
    select conv_id, case when m is null and docs = 0 then case when prefer = 'OFFLINE' then 'OFFLINE_ARCHIVE' else 'LOCAL_WEIGHTS' end when docs > 0 and (not web or m is null) then 'OFFLINE_ARCHIVE' else coalesce(m, 'LOCAL_WEIGHTS') end as mode from w"""
)
def r11_answer_modes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", "OFFLINE").when(F.col("turn") > 4, "ONLINE")).alias("prefer"), (F.count_if(F.col("role") == "user") > 2).alias("web"), F.max("turn").alias("t"))
    return n.select("conv_id", retrieval.answer_mode(F.col("prefer"), F.col("web"), F.col("t") % 3, F.col("t") % 2, F.col("conv_id") % 2).alias("mode"))


# Z, A9, A11: freshness

NOW = datetime(2024, 1, 15, 12)
_SOURCES_SQL = """s as (select event_type as name, 'table' as type, 600::int as ttl_minutes, 'events' as description, max(ts) as last_modified, null::varchar as fetch_error from events group by 1
  union all select n_name, 'file', 60, 'none', null, case when n_nationkey % 2 = 0 then 'not reachable' end from nation
  union all select r_name, 'file', 60, 'clock', timestamp '2024-01-15 11:00:00' + to_minutes(r_regionkey * 30), null from region)"""
_STATUS = "case when last_modified is null and fetch_error is not null then 'error' when last_modified is null then 'unknown' when epoch(timestamp '2024-01-15 12:00:00') - epoch(last_modified) <= ttl_minutes * 60 then 'fresh' else 'stale' end"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = freshness.newest_by_source(table(spark, sf_dir, "events"), "event_type", "ts")
    text = lambda c: F.lit(c).cast("string")
    a = newest.select("name", text("table").alias("type"), F.lit(600).alias("ttl_minutes"), text("events").alias("description"), "last_modified", text(None).alias("fetch_error"))
    n = table(spark, sf_dir, "nation")
    b = n.select(F.col("n_name").alias("name"), text("file").alias("type"), F.lit(60).alias("ttl_minutes"), text("none").alias("description"), F.lit(None).cast("timestamp_ntz").alias("last_modified"), F.when(F.col("n_nationkey") % 2 == 0, "not reachable").alias("fetch_error"))
    at = F.expr("timestamp_ntz '2024-01-15 11:00:00' + make_dt_interval(0, 0, r_regionkey * 30, 0)")
    c = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), text("file").alias("type"), F.lit(60).alias("ttl_minutes"), text("clock").alias("description"), at.alias("last_modified"), text(None).alias("fetch_error"))
    return a.unionByName(b).unionByName(c)


def _now():
    return F.lit(NOW.isoformat(" ")).cast("timestamp_ntz")


over("a09_newest_time", "events", lambda d: freshness.newest_time(d, "ts"), "select max(ts) as last_modified from events")
for _name, _where in (("any", "true"), ("views", "event_type <> 'click'"), ("odd", "event_type = 'error'")):
    # clicks tell their times with a T and without fractions, errors in a notation that is not read
    register(
        f"a09_newest_text_{_name}",
        lambda s, d, where=_where: freshness.newest_time(table(s, d, "events").where(where).select(F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_type") == "error", F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("at")), "at"),
        f"with t as (select max(case when event_type = 'click' then strftime(ts, '%Y-%m-%dT%H:%M:%S') when event_type = 'error' then strftime(ts, '%d.%m.%Y') else strftime(ts, '%Y-%m-%d %H:%M:%S.%f') end) as tm from events where {_where}) select coalesce(try_strptime(tm, '%Y-%m-%d %H:%M:%S.%f'), try_strptime(tm, '%Y-%m-%d %H:%M:%S'), try_strptime(tm, '%Y-%m-%dT%H:%M:%S.%f'), try_strptime(tm, '%Y-%m-%dT%H:%M:%S')) as last_modified from t",
    )
register("z01_statuses", lambda s, d: sources(s, d).where("fetch_error is null").select("name", freshness.status(F.col("last_modified"), F.col("ttl_minutes"), _now()).alias("status")), f"with {_SOURCES_SQL} select name, {_STATUS} as status from s where fetch_error is null")
register(
    "z02_details", lambda s, d: freshness.details(sources(s, d), _now()).select("source_name", "status", F.round("age_seconds", 1).alias("age_seconds"), F.round("time_until_stale_minutes", 1).alias("left_minutes"), "error_message"),
    f"""with {_SOURCES_SQL}, g as (select *, epoch(timestamp '2024-01-15 12:00:00') - epoch(last_modified) as age from s) select name as source_name, {_STATUS} as status, round(case when age < 0 then 0 else age end, 1) as age_seconds,
    round(round((case when age < 0 then ttl_minutes * 60 else ttl_minutes * 60 - age end) / 60, 2), 1) as left_minutes, case when last_modified is null then coalesce(fetch_error, 'No last modified timestamp available') when age < 0 then 'Last modified timestamp is in the future (clock skew)' end as error_message from g""",
)
register(
    "z03_a11_overview", lambda s, d: freshness.overview(freshness.details(sources(s, d), _now())),
    f"with {_SOURCES_SQL}, x as (select {_STATUS} as status from s), n as (select count(*) as total_sources, count_if(status = 'fresh')::bigint as fresh_count, count_if(status = 'stale')::bigint as stale_count, count_if(status = 'error')::bigint as error_count, count_if(status = 'unknown')::bigint as unknown_count from x) select *, case when stale_count > 0 then 'stale' when error_count > 0 then 'error' when unknown_count > 0 and fresh_count = 0 then 'unknown' when fresh_count > 0 then 'fresh' else 'unknown' end as overall_status from n",
)


@query()
def z04_last_modified(spark, sf_dir):
    """The newest time of each event type and of the files they are in."""
    rows = freshness.newest_by_source(table(spark, sf_dir, "events"), "event_type", "ts")
    files = spark.read.format("binaryFile").load(f"{sf_dir}/events.parquet").select(F.lit("events file").alias("name"), F.col("modificationTime").cast("timestamp_ntz").alias("last_modified"))
    return rows.unionByName(files.groupBy("name").agg(F.max("last_modified").alias("last_modified")))


@query(f"with {_SOURCES_SQL} select lower(name) as name, ttl_minutes from s where regexp_matches(name, '^[A-Za-z0-9_-]+$') and length(name) <> 5")
def z05_enabled_sources(spark, sf_dir):
    s = sources(spark, sf_dir).withColumn("enabled", F.length("name") != 5)
    return freshness.enabled_sources(s).select("name", "ttl_minutes")


@query(f"with {_SOURCES_SQL} select lower(name) as name, ttl_minutes from s where lower(name) = 'nation_7' and length(name) <> 5")
def z05_source_named(spark, sf_dir):
    s = sources(spark, sf_dir).withColumn("enabled", F.length("name") != 5)
    return freshness.source_named(s, "Nation_7").select("name", "ttl_minutes")


# Q: question logs, over the texts of conversations and questions made from nations


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("question_id"), F.col("text").alias("query"))
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("string")
    forms = F.array(
        F.concat(F.lit("How many customers in "), "n_name"), F.concat(F.lit("list first "), k, F.lit(" rows of 100 Sales Record file")), F.concat(F.lit("will sales in "), "n_name", F.lit(" grow next year?")), F.concat(F.lit("show row "), k, F.lit(" from "), F.lower("n_name")),
        F.concat(F.lit("the customer #"), k, F.lit(" in the last-sales.csv file")), F.concat(F.lit("who has "), k, F.lit(" in the Index column")), F.concat(F.lit("where Country is "), "n_name"), F.concat(F.lit("compare "), "n_name", F.lit(" by category, limit "), k), F.concat(k, F.lit("th record, top 900")), F.lit("  "),
    )
    return c.unionByName(n.select((-F.col("n_nationkey") * 100).cast("bigint").alias("a"), F.posexplode(forms).alias("i", "query")).select((F.col("a") - F.col("i") - 1).alias("question_id"), "query"))


_LOG_SQL = """l as (select conv_id * 10 + turn as question_id, text as query from conversations union all select -100 * n_nationkey - i - 1, f from (select n_nationkey, unnest([0,1,2,3,4,5,6,7,8,9]) as i, unnest(['How many customers in ' || n_name, 'list first ' || n_nationkey || ' rows of 100 Sales Record file', 'will sales in ' || n_name || ' grow next year?', 'show row ' || n_nationkey || ' from ' || lower(n_name),
  'the customer #' || n_nationkey || ' in the last-sales.csv file', 'who has ' || n_nationkey || ' in the Index column', 'where Country is ' || n_name, 'compare ' || n_name || ' by category, limit ' || n_nationkey, n_nationkey || 'th record, top 900', '  ']) as f from nation))"""


def _re(p: str) -> str:
    return p.replace("'", "''")


def _any_sql(patterns) -> str:
    return "regexp_matches(query, '(?i)" + "|".join(f"(?:{_re(p)})" for p in patterns) + "')"


def _group_sql(p: str, n: int = 1) -> str:
    return f"nullif(regexp_extract(query, '(?i){_re(p)}', {n}), '')"


def _log(name: str, make, sql: str | None) -> None:
    register(name, lambda s, d: log(s, d).select("question_id", *make(F.col("query"))), f"with {_LOG_SQL} select question_id, {sql} from l" if sql else None)


_log("q01_routes", lambda q: [intents.route(q).alias("route")], f"case when trim(query) = '' then 'empty_query' when {_any_sql(intents.AGGREGATION)} then 'aggregation_intent' when {_any_sql(intents.LISTING)} then 'list_filter_intent' else 'default_rag' end as route")
_log("q02_predictive", lambda q: [intents.is_predictive(q).alias("predictive")], f"regexp_matches(lower(query), '{'|'.join(intents.PREDICTIVE)}') or (contains(lower(query), 'will') and regexp_matches(lower(query), '{'|'.join(intents.PREDICTIVE_WITH_WILL)}')) as predictive")
_ROWS = ", ".join(f"case when try_cast({_group_sql(p)} as bigint) > 0 then {{}} end" for p, _ in intents.ROW)
_log(
    "q03_row_intents", lambda q: [intents.row_intent(q)["row_number"].alias("row_number"), intents.row_intent(q)["confidence"].alias("confidence")],
    "coalesce(" + _ROWS.format(*[f"try_cast({_group_sql(p)} as bigint)" for p, _ in intents.ROW]) + ") as row_number, coalesce(" + _ROWS.format(*[f"{c}::double" for _, c in intents.ROW]) + ") as confidence",
)


def _cv(which: str) -> str:
    parts = []
    for p, order in intents.COLUMN_VALUE:
        name, value = (2, 1) if order == "value_first" else (1, 2)
        parts.append(f"when {_group_sql(p, 0)} is not null then {_group_sql(p, name if which == 'name' else value)}")
    return "case " + " ".join(parts) + " end"


_log("q04_column_values", lambda q: [intents.column_value_intent(q)["column_name"].alias("column_name"), intents.column_value_intent(q)["value"].alias("value")], f"{_cv('name')} as column_name, {_cv('value')} as value")
_log("q05_files", lambda q: [intents.file_intent(q).alias("file"), intents.wants_last(q).alias("wants_last")], f"coalesce({_group_sql(intents.FILE_FROM)}, {_group_sql(intents.FILE_IN)}) as file, {_any_sql([intents.LAST])} as wants_last")
_log("q06_requested_rows", lambda q: [intents.requested_rows(q).alias("rows")], "case when {0} > 500 then 500 else {0} end as rows".format("coalesce(" + ", ".join(f"try_cast({_group_sql(p)} as bigint)" for p in intents.ROW_COUNT) + ")"))
_log("q07_chart_types", lambda q: [intents.chart_type(q).alias("chart")], "case when regexp_matches(lower(query), '" + "|".join(intents.LINE_CHART) + "') then 'line_chart' when regexp_matches(lower(query), '" + "|".join(intents.BAR_CHART) + "') then 'bar_chart' else 'line_chart' end as chart")

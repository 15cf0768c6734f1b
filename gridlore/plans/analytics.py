"""Queries of the nine operations, their filters, orders and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions import intents
from gridlore.functions.filters import Filter
from gridlore.operators import analytics as a
from gridlore.operators.profile import profile

from .registry import over, query, table

over(
    "analytics_entry", "lineitem", lambda d: a.groupby_sum(d, "l_returnflag", "l_extendedprice", [Filter("l_shipdate", "year_equals", 1996)], "value_desc", 3).select("key", F.round("value", 2).alias("value")),
    "select l_returnflag as key, round(sum(l_extendedprice), 2) as value from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' group by 1 order by sum(l_extendedprice) desc, 1 limit 3",
)

# rows that pass a filter, counted, with a sum that tells which they were
_O, _OS = "orders", "select count(*) as n, coalesce(sum(o_orderkey), 0)::bigint as keys from orders where "


def _passing(name: str, f: Filter, sql: str, **how) -> None:
    def run(d):
        kept = d.where(a_predicate(d, f, **how))
        return kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("keys"))

    from gridlore.functions.filters import predicate as a_predicate

    over(name, _O, run, _OS + sql)


_passing("p02_eq", Filter("o_orderstatus", "eq", "F"), "o_orderstatus = 'F'")
_passing("p03_neq", Filter("o_orderstatus", "neq", "F"), "o_orderstatus <> 'F'")
_passing("p08_contains", Filter("o_orderpriority", "contains", "high"), "o_orderpriority ilike '%high%'")
_passing("p09_startswith", Filter("o_orderpriority", "startswith", "1-u"), "o_orderpriority ilike '1-u%'")
_passing("p09_startswith_exact", Filter("o_orderpriority", "startswith", "1-U"), "starts_with(o_orderpriority, '1-U')", literal=True, case_sensitive=True)
_passing("p10_year_equals", Filter("o_orderdate", "year_equals", 1996), "o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'")
_passing("p11_month_equals", Filter("o_orderdate", "month_equals", "1996-12"), "o_orderdate >= timestamp '1996-12-01' and o_orderdate < timestamp '1997-01-01'")
_passing("p12_between_dates", Filter("o_orderdate", "between_dates", ["1995-03-05", "1996-02-29"]), "o_orderdate >= timestamp '1995-03-05' and o_orderdate < timestamp '1996-03-01'")
_passing("p12_date_text_compared", Filter("o_orderdate", "gte", "1997-06-01"), "o_orderdate >= timestamp '1997-06-01'")

_LS = "select count(*) as n, coalesce(sum(l_orderkey), 0)::bigint as keys from lineitem where "
for _name, _op, _sign in (("p04_gt", "gt", ">"), ("p05_gte", "gte", ">="), ("p06_lt", "lt", "<"), ("p07_lte", "lte", "<=")):
    over(
        _name, "lineitem", lambda d, op=_op: a.apply_filters(d, [Filter("l_quantity", op, 25)]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("l_orderkey"), F.lit(0)).alias("keys")),
        f"{_LS} l_quantity {_sign} 25",
    )


def _nulled(d):
    """orders with the price of finished orders gone."""
    return d.withColumn("o_totalprice", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))


over("p13_is_null", _O, lambda d: a.count_rows(_nulled(d), [Filter("o_totalprice", "is_null")]), "select count(*) as count from orders where o_orderstatus = 'F'")
over("p14_is_not_null", _O, lambda d: a.count_rows(_nulled(d), [Filter("o_totalprice", "is_not_null")]), "select count(*) as count from orders where o_orderstatus <> 'F'")
over("p15_conjunction", _O, lambda d: a.count_rows(d, [Filter("o_orderstatus", "eq", "O"), Filter("o_totalprice", "gt", 1000), Filter("o_orderpriority", "contains", "urgent")]), "select count(*) as count from orders where o_orderstatus = 'O' and o_totalprice > 1000 and o_orderpriority ilike '%urgent%'")
over(
    "p01_select_rows", _O, lambda d: a.select_rows(d, ["o_orderkey", "o_orderstatus", "o_totalprice"], [Filter("o_orderstatus", "eq", "P")], 100, ["o_orderkey"]),
    "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'P' order by o_orderkey limit 100",
)
over(
    "p19_ordered_columns", _O, lambda d: a.ordered_columns(d.withColumnRenamed("o_custkey", "_custkey"), ["o_orderpriority", "o_orderkey"]),
    "select o_orderpriority, o_orderkey, o_orderstatus, o_totalprice, o_orderdate from orders",
)

over("a01_count_rows", _O, a.count_rows, "select count(*) as count from orders")
over("a02_count_distinct", _O, lambda d: a.count_distinct(d, "o_custkey"), "select count(distinct o_custkey) as count_distinct from orders")
over("a03_sum", "lineitem", lambda d: a.sum_of(d, "l_quantity"), "select coalesce(sum(l_quantity), 0) as sum from lineitem")
over("a03_sum_of_nothing", "lineitem", lambda d: a.sum_of(d, "l_quantity", [Filter("l_quantity", "lt", -1)]), "select coalesce(sum(l_quantity), 0) as sum from lineitem where l_quantity < -1")
over("a04_avg", "lineitem", lambda d: a.avg_of(d, "l_quantity", [Filter("l_returnflag", "eq", "R")]), "select round(avg(l_quantity), 4) as avg from lineitem where l_returnflag = 'R'")
over("a05_min", _O, lambda d: a.min_of(d, "o_orderdate"), "select min(o_orderdate) as min from orders")
over("a06_max", _O, lambda d: a.max_of(d, "o_orderpriority"), "select max(o_orderpriority) as max from orders")
over("a07_groupby_count", "events", lambda d: a.groupby_count(d, "event_type"), "select event_type as key, count(*) as count from events group by 1 order by 2 desc, 1 limit 50")
over("a07_groupby_count_of_null", _O, lambda d: a.groupby_count(_nulled(d).withColumn("low", F.col("o_totalprice") < 100_000), "low"), "select case when o_orderstatus <> 'F' then o_totalprice < 100000 end as key, count(*) as count from orders group by 1")
over("a08_groupby_sum", "lineitem", lambda d: a.groupby_sum(d, "l_returnflag", "l_quantity"), "select l_returnflag as key, coalesce(sum(l_quantity), 0) as value from lineitem group by 1")
for _order, _by in (("count_desc", "2 desc, 1"), ("count_asc", "2, 1"), ("key_asc", "1"), ("key_desc", "1 desc"), ("value_desc", "2 desc, 1")):
    over(f"t01_count_{_order}", "customer", lambda d, o=_order: a.groupby_count(d, "c_nationkey", order=o, top_n=7), f"select c_nationkey as key, count(*) as count from customer group by 1 order by {_by} limit 7")
for _order, _by in (("value_desc", "2 desc, 1"), ("value_asc", "2, 1"), ("count_desc", "2 desc, 1"), ("key_desc", "1 desc"), ("key_asc", "1")):
    over(f"t02_sum_{_order}", "lineitem", lambda d, o=_order: a.groupby_sum(d, "l_suppkey", "l_quantity", order=o, top_n=5), f"select l_suppkey as key, sum(l_quantity) as value from lineitem group by 1 order by {_by} limit 5")
over("t03_clamped_groups", "lineitem", lambda d: a.groupby_count(d, "l_partkey", top_n=5000), "select l_partkey as key, count(*) as count from lineitem group by 1 order by 2 desc, 1 limit 1000")
over("t03_clamped_rows", _O, lambda d: a.select_rows(d, ["o_orderkey"], limit=9999, order_by=["o_orderkey"]), "select o_orderkey from orders order by 1 limit 500")


@query("with n as (select count(distinct o_custkey) as d, sum(o_custkey) as s, count(*) as row_count from orders) select 'count_distinct' as operation, d as value, row_count, d > row_count as warning from n union all select 'sum', s, row_count, s > row_count from n")
def a12_exceeds_profile(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    stats = profile(d, ["o_custkey"]).select("row_count")
    found = [a.exceeds_profile(one, name, stats).select(F.lit(name).alias("operation"), F.col(name).cast("bigint").alias("value"), "row_count", "warning") for name, one in (("count_distinct", a.count_distinct(d, "o_custkey")), ("sum", a.sum_of(d, "o_custkey")))]
    return found[0].unionByName(found[1])


@query("select l_returnflag, l_linestatus, count(*) as n from (select l_returnflag, l_linestatus, row_number() over (order by l_orderkey, l_linenumber, l_returnflag, l_linestatus) as r from lineitem) where r <= (select max(n_nationkey) from nation) group by 1, 2")
def t07_requested_rows_applied(spark, sf_dir):
    """The largest row count asked for in a log of questions as the limit of a selection."""
    log = table(spark, sf_dir, "nation").select(F.concat(F.lit("list first "), F.col("n_nationkey").cast("string"), F.lit(" rows of 100 Sales Record file")).alias("query"))
    wanted = log.agg(F.max(intents.requested_rows(F.col("query"))).alias("n")).first()["n"]
    rows = a.select_rows(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], limit=wanted, order_by=["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))

"""The operations on small tables with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlore.functions.filters import Filter, PlanError, predicate
from gridlore.operators import analytics as a
from gridlore.operators.profile import profile


@pytest.fixture(scope="module")
def customers(spark):
    days = ["2020-03-15", "2020-07-01", "2020-11-30", "2020-12-31", "2021-01-01", "2021-06-15", "2021-12-31", "2022-02-28", "2022-06-01", "2022-12-15"]
    rows = [(i, f"C{i:04d}", dt.datetime.fromisoformat(d), 100.0 + i, i % 2 == 0) for i, d in enumerate(days, 1)]
    return spark.createDataFrame(rows, "Index long, `Customer Id` string, `Subscription Date` timestamp_ntz, Amount double, Active boolean").cache()


def count(df, *filters):
    return a.count_rows(df, filters).first()["count"]


def test_years_add_up_to_all(customers):
    years = [count(customers, Filter("Subscription Date", "year_equals", y)) for y in (2020, 2021, 2022)]
    assert years == [4, 3, 3] and sum(years) == count(customers) == 10


def test_months_and_days(customers):
    assert count(customers, Filter("Subscription Date", "month_equals", "2020-03")) == 1
    assert count(customers, Filter("Subscription Date", "month_equals", "2020-12")) == 1
    assert count(customers, Filter("Subscription Date", "between_dates", ["2020-01-01", "2020-12-31"])) == 4


def test_booleans_and_selection(customers):
    assert count(customers, Filter("Active", "eq", 1)) == 5
    rows = a.select_rows(customers, ["Index", "Customer Id"], [Filter("Active", "eq", True)]).collect()
    assert len(rows) == 5 and rows[0].asDict().keys() == {"Index", "Customer Id"}
    assert len(a.select_rows(customers, filters=[Filter("Index", "eq", 1)]).first()) == 5


def test_group_sum_picks_the_largest(spark):
    df = spark.createDataFrame([("The Gambia", 100.0)] * 4 + [("USA", 1200.0), ("USA", 800.0)], "Country string, `Total Revenue` double")
    assert a.groupby_sum(df, "Country", "Total Revenue", order="value_desc", top_n=1).first().asDict() == {"key": "USA", "value": 2000.0}


def test_null_sums_sort_as_null_and_show_as_zero(spark):
    df = spark.createDataFrame([("a", -1.0), ("b", None), (None, 2.0)], "k string, v double")
    assert [(r["key"], r["value"]) for r in a.groupby_sum(df, "k", "v").collect()] == [(None, 2.0), ("a", -1.0), ("b", 0.0)]


@pytest.mark.parametrize(
    "make",
    [
        lambda d: a.sum_of(d, None), lambda d: a.sum_of(d, "Customer Id"), lambda d: a.groupby_sum(d, "", "Amount"), lambda d: a.groupby_sum(d, "Customer Id", "Customer Id"), lambda d: a.count_rows(d, [Filter("Subscription Date", "contains", "x")]),
        lambda d: a.count_rows(d, [Filter("Amount", "year_equals", 2020)]), lambda d: a.count_rows(d, [Filter("nope", "eq", 1)]), lambda d: a.count_rows(d, [Filter("Amount", "eq")]), lambda d: a.count_rows(d, [Filter("Subscription Date", "month_equals", "2020")]), lambda d: a.groupby_count(d, "Active", order="up"),
    ],
)
def test_rejected(customers, make):
    with pytest.raises(PlanError):
        make(customers)


def test_hidden_columns(spark):
    df = spark.createDataFrame([(1, 2)], "_secret int, shown int")
    assert a.select_rows(df).columns == ["shown"]
    with pytest.raises(PlanError):
        a.min_of(df, "_secret")


def test_like_rules(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), ("a\\b",), (None,)], "s string")
    hits = lambda v, **k: df.where(predicate(df, Filter("s", "contains", v), **k)).count()
    assert hits("50%") == 2 and hits("50%", literal=True) == 1 and hits("A\\B") == 1 and hits("OFF") == 2 and hits("OFF", case_sensitive=True, literal=True) == 0


def test_date_filters_reach_the_scan(spark, tmp_path, customers):
    customers.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = a.count_rows(df, [Filter("Subscription Date", "year_equals", 2020)])._jdf.queryExecution().executedPlan().toString()
    assert "terThanOrEqual(`Subscription Date`,2020-01-01T00:00), LessTh" in plan and "ReadSchema: struct<Subscription Date:timestamp_ntz>" in plan


def test_clamps(customers):
    assert (a.clamp(None, 500), a.clamp(0, 500), a.clamp(9999, 500)) == (50, 1, 500)


def test_profile(customers):
    rows = {r["column_name"]: r for r in profile(customers).collect()}
    assert list(rows) == sorted(rows)
    assert rows["Index"]["row_count"] == 10 and rows["Index"]["distinct_count"] == 10 and rows["Index"]["median"] == 5.5 and rows["Active"]["top_values"] == {"false": 5, "true": 5}
    one = profile(customers.limit(1).select("Amount", F.lit(None).cast("double").alias("none"))).collect()
    assert one[0]["std"] is None and one[1]["missing_count"] == 1 and one[1]["distinct_count"] == 0
    near = {r["column_name"]: r["distinct_count"] for r in profile(customers, approximate=True).collect()}
    assert near["Index"] == 10


def test_empty_table(customers):
    none = customers.where("false")
    assert a.sum_of(none, "Amount").first()["sum"] == 0 and a.avg_of(none, "Amount").first()["avg"] is None and a.groupby_count(none, "Active").count() == 0
    assert profile(none).count() == 5

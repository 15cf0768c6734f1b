"""Every query of the library against its SQL on the smallest tables; those without SQL give rows with a stable schema."""

import pytest

import gridlore.plans.all as plans

from .oracle import database, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
EMPTY_ALLOWED = {"s18_empty_scope"}


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    names, want = rows_of_sql(db, plans.SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_gives_rows(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert df.columns
    assert df.count() > 0 or name in EMPTY_ALLOWED


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query of the core against its SQL, on the smallest tables."""

import pytest
from comparing import assert_same, views

from quern.plans import control, engine, general

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = engine.QUERIES | control.QUERIES | general.QUERIES, engine.SQL | control.SQL | general.SQL


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, con):
    assert_same(QUERIES[name](spark, FOLDER), con, SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(SQL) <= set(__spark_entry__.oracle_sql())

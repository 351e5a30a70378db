"""Registered queries against their SQL over odd amounts; DuckDB reads tables in memory, so that no file statistics take part."""

import math
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from comparing import assert_same

from quern.plans.engine import QUERIES, SQL

NAN = math.nan


@pytest.fixture
def same(spark, tmp_path):
    """Holds a query against its SQL where sales have the given amounts."""

    def check(name, amounts):
        n = len(amounts)
        at = [datetime(2024, 3, 1) + timedelta(hours=i) for i in range(n)]
        sales = pa.table({"id": range(n), "region": [("east", "west")[i % 2] for i in range(n)], "customer_id": [1] * n, "amount": pa.array(amounts, pa.float64()), "active": [True] * n, "sold_at": at, "loaded_at": at})
        customers = pa.table({"customer_id": [1], "name": ["Ada"], "tier": ["gold"]})
        con = duckdb.connect()
        for table, rows in (("sales", sales), ("customers", customers)):
            pq.write_table(rows, tmp_path / f"{table}.parquet")
            con.register("rows", rows)
            con.execute(f"CREATE TABLE {table} AS FROM rows").fetchall()
            con.unregister("rows")
        assert_same(QUERIES[name](spark, str(tmp_path)), con, SQL[name])

    return check


@pytest.mark.parametrize("name", ["scan_filter_project", "filter_or_null", "filter_sort_limit", "two_stage_aggregate", "join_filter"])
def test_nan_among_low_amounts_is_kept(same, name):
    same(name, [1.0, NAN, 2.5, NAN])


def test_comparisons_that_nan_passes(session, tmp_path):
    pq.write_table(pa.table({"x": [1.0, 1.0, NAN], "f": pa.array([1.0, 1.0, NAN], pa.float32())}), tmp_path / "x.parquet")
    session.register_parquet("x", tmp_path / "x.parquet")
    for test, n in (("x > 5", 1), ("x >= 5.5", 1), ("5 < x", 1), ("5 <= x", 1), ("x <> 1", 1), ("1.0 <> x", 1), ("f > 5", 1), ("x < 5", 2), ("5 > x", 2), ("x = 1", 2)):
        assert session.execute_sql(f"SELECT COUNT(*) AS n FROM x WHERE {test}").rows() == [(n,)], test


#: Numbers whose seventh decimal is a 5 in decimal digits, and above or below it as scaled doubles; also what scaling makes infinite.
HALVES = [1116.9859745, 1031.7099895, 295.4580895, 266.8589575, -1116.9859745, 73.1293425, 133.6712715, 1e300, 1.7e308, math.inf, -math.inf, NAN, None, 2.5e-7, -0.0]


@pytest.mark.parametrize("name", ["filter_or_null", "filter_sort_limit", "full_sort", "topk", "join_filter"])
def test_rounding_takes_the_ties_of_the_sql(same, name):
    same(name, HALVES)


def test_rounding_of_a_product(same):
    same("scan_filter_project", [50.00003875, 50.00007625, 50.00011375, 50.000177083333334, 50.000202916666666])


def test_places_of_amounts_with_more_decimals(same):
    same("sort_places", [*HALVES, 100.0000005, 100.0000015, 100.0000025])


def test_only_means_are_nudged(same):
    same("two_stage_aggregate", [10.004999, 30.5, 12.5, 70.004999, 11.004999])

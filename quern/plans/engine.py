"""Queries of the engine's own operators over the shared tables, and their SQL.

Most go through the SQL front end; the others build relations. Float
aggregates are rounded, since the order of summation is not fixed. Where a
float column may hold NaN, its name comes after that of a key column, so that
a comparison that sorts rows by their columns in the order of names does not
depend on how NaN is sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan

from quern.expr import agg, col, count_star, lit
from quern.operators.materialize import remember, shared_dir
from quern.operators.numbering import numbered
from quern.relation import SortKey
from quern.session import Session
from quern.sources.provider import TableProvider

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "sales", "shop_orders", "customers", "keyed", "mix_targets"]


class _Lazy(Session):
    """A session that opens a Parquet table when it is first named."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark=spark)
        self._folder = sf_dir

    def table(self, name, alias=None, columns=None):
        if name.lower() not in self._tables and name.lower() in TABLES:
            self.register_parquet(name, f"{self._folder}/{name.lower()}.parquet")
        return super().table(name, alias, columns)


#: Added to floats before rounding: means of few decimals often lie halfway between two, where the order of summation decides.
NUDGE = 1.3e-6


def _round(value: Column, places: int) -> Column:
    """Rounding as in the SQL: the scaled number's halves go away from zero; what overflows by scaling stays.

    Spark's own round looks at the decimal digits, and so takes other ties.
    """
    scaled = value * 10.0**places
    whole = F.rint(scaled)  # halves to even
    rest = scaled - whole
    whole = F.when((rest == 0.5) & (scaled > 0), whole + 1.0).when((rest == -0.5) & (scaled < 0), whole - 1.0).otherwise(whole)
    found = whole / 10.0**places
    return F.when(F.abs(found) < float("inf"), found).otherwise(value)


def _rounded(df: DataFrame, places: int | None, means: Collection[str] | None = None) -> DataFrame:
    """Floats rounded; to fewer than six places those in ``means``, or all (None), are nudged before."""
    if places is None:
        return df
    nudged = [c for c in df.columns if means is None or c in means] if places < 6 else []
    moved = lambda c: F.col(f"`{c}`") + NUDGE if c in nudged else F.col(f"`{c}`")
    return df.select(*(_round(moved(c), places).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def _run(sql: str, places: int | None = None, means: Collection[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(_Lazy(spark, sf_dir).sql(sql).to_df(), places, means)


def _relation(build: Callable[[Session], object], places: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(build(_Lazy(spark, sf_dir)).to_df(), places)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str, oracle: str | None = None, places: int | None = None, means: Collection[str] | None = None) -> None:
    """A query in the engine's SQL; DuckDB gets the same text unless its meaning differs there."""
    QUERIES[name], SQL[name] = _run(sql, places, means), oracle or sql


def _built(name: str, build: Callable[[Session], object], oracle: str, places: int | None = None) -> None:
    QUERIES[name], SQL[name] = _relation(build, places), oracle


# projection, filter, predicates
_add("scan_project_alias", "SELECT n_nationkey AS k, n_name AS name, n_regionkey * 2 AS twice FROM nation", "SELECT n_nationkey AS k, n_name AS name, CAST(n_regionkey AS BIGINT) * 2 AS twice FROM nation")
_add("select_star", "SELECT * FROM region")
_add("star_and_expr", "SELECT *, r_regionkey + 1 AS next FROM region", "SELECT *, CAST(r_regionkey AS BIGINT) + 1 AS next FROM region")
_add("filter_cmp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45.0 AND l_discount <= 0.05 AND l_returnflag <> 'N'", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45.0 AND l_discount <= 0.05::DOUBLE AND l_returnflag <> 'N'")
_add("scan_filter_project", "SELECT id, amount * 1.2 AS value FROM sales WHERE active = TRUE AND amount > 50", "SELECT id, round(amount * 1.2::DOUBLE, 6) AS value FROM sales WHERE active AND amount > 50", 6)
_add("filter_or_null", "SELECT id, amount AS value FROM sales WHERE amount > 1000 OR amount IS NULL", "SELECT id, round(amount, 6) AS value FROM sales WHERE amount > 1000 OR amount IS NULL", 6)
_add("filter_is_not_null", "SELECT row_id, code FROM keyed WHERE category IS NULL AND code IS NOT NULL")
_add("null_predicate", "SELECT id, amount IS NULL AS missing FROM sales")
_add("kleene", "SELECT row_id, code > 5 OR category = 'a' AS either, code > 5 AND category = 'a' AS both FROM keyed")
_add("where_or_literal_null", "SELECT COUNT(*) AS n FROM sales WHERE active OR NULL", "SELECT count(*) AS n FROM sales WHERE active OR NULL::BOOLEAN")
_add("compare_int_float", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= l_quantity")
_add("compare_timestamps", "SELECT id, sold_at, loaded_at > sold_at AS late FROM sales")
_add("literals", "SELECT r_regionkey, 1 AS i, 1.5 AS f, 'it''s' AS s, TRUE AS t, CAST(NULL AS BIGINT) AS nothing FROM region", "SELECT r_regionkey, 1::BIGINT AS i, 1.5::DOUBLE AS f, 'it''s' AS s, true AS t, NULL::BIGINT AS nothing FROM region")
_add("filter_sort_limit", "SELECT id, amount AS value FROM sales WHERE amount >= 22 ORDER BY value DESC, id LIMIT 100", "SELECT id, round(amount, 6) AS value FROM sales WHERE amount >= 22 ORDER BY amount DESC NULLS FIRST, id LIMIT 100", 6)
# arithmetic and casts
_add("int_arithmetic", "SELECT p_partkey, p_size + 1 AS a, p_size - 100 AS s, p_size * p_size AS m FROM part", "SELECT p_partkey, p_size::BIGINT + 1 AS a, p_size::BIGINT - 100 AS s, p_size::BIGINT * p_size AS m FROM part")
_add("int_div", "SELECT o_orderkey, o_custkey / 7 AS q FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q FROM orders")
_add("float_div", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem")
_add("float_div_zero", "SELECT id, amount / 0.0 AS q, 0.0 / amount AS r FROM sales", "SELECT id, amount / 0.0::DOUBLE AS q, 0.0::DOUBLE / amount AS r FROM sales")
_add("cast_trunc", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS whole FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS whole FROM lineitem")
_add("cast_str", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS text FROM orders")
_add("cast_lenient", "SELECT n_nationkey, CAST(n_name AS INT) AS bad, '12'::int AS good, CAST('x' AS DOUBLE) AS none FROM nation", "SELECT n_nationkey, TRY_CAST(n_name AS INT) AS bad, 12::INT AS good, TRY_CAST('x' AS DOUBLE) AS none FROM nation")
_add("cast_narrow", "SELECT o_orderkey, CAST(o_orderkey * 1000000 AS INT) AS i FROM orders", "SELECT o_orderkey, TRY_CAST(o_orderkey * 1000000 AS INT) AS i FROM orders")
_add("cast_unsigned", "SELECT id, CAST(id AS BIGINT UNSIGNED) AS u, CAST(id - 100 AS INT UNSIGNED) AS small FROM sales", "SELECT id, CAST(id AS DECIMAL(20,0)) AS u, CAST(TRY_CAST(id - 100 AS UINTEGER) AS BIGINT) AS small FROM sales")
_add("cast_real", "SELECT p_partkey, CAST(p_size AS REAL) AS r, CAST(p_size > 10 AS INT) AS flag, CAST(NULL AS TEXT) AS t FROM part")
# aggregation
_add("agg_group", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_extendedprice) AS revenue, AVG(l_quantity) AS mean, MIN(l_discount) AS low, MAX(l_tax) AS high FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_quantity) + 1.3e-6, 2) AS mean, min(l_discount) AS low, max(l_tax) AS high FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag", 2)
_add("hash_aggregate", "SELECT region, COUNT(*) AS n, SUM(amount) AS total, AVG(amount) AS typical FROM sales GROUP BY region", "SELECT region, count(*) AS n, round(sum(amount), 2) AS total, round(avg(amount) + 1.3e-6, 2) AS typical FROM sales GROUP BY region", 2)
_add("two_stage_aggregate", "SELECT region, COUNT(*) AS n, SUM(amount) AS total, AVG(amount) AS typical, MIN(amount) AS value_low, MAX(amount) AS value_high FROM sales WHERE amount > 10 GROUP BY region", "SELECT region, count(*) AS n, round(sum(amount), 2) AS total, round(avg(amount) + 1.3e-6, 2) AS typical, round(min(amount), 2) AS value_low, round(max(amount), 2) AS value_high FROM sales WHERE amount > 10 GROUP BY region", 2, means=["typical"])
_add("multi_key_aggregate", "SELECT region, customer_id, COUNT(*) AS n, SUM(amount) AS total FROM sales GROUP BY region, customer_id", "SELECT region, customer_id, count(*) AS n, round(sum(amount), 2) AS total FROM sales GROUP BY region, customer_id", 2)
_add("group_null_keys", "SELECT category, code, COUNT(*) AS n, SUM(amount) AS total FROM keyed GROUP BY category, code", "SELECT category, code, count(*) AS n, round(sum(amount), 2) AS total FROM keyed GROUP BY category, code", 2)
_add("agg_int_sum_double", "SELECT l_returnflag, SUM(l_linenumber) AS s, AVG(l_orderkey) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS DOUBLE) AS s, round(avg(l_orderkey) + 1.3e-6, 2) AS a FROM lineitem GROUP BY l_returnflag", 2)
_add("agg_distinct", "SELECT COUNT(DISTINCT customer_id) AS n, SUM(DISTINCT customer_id) AS s, AVG(DISTINCT customer_id) AS a, MIN(DISTINCT customer_id) AS low FROM shop_orders", "SELECT count(DISTINCT customer_id) AS n, CAST(sum(DISTINCT customer_id) AS DOUBLE) AS s, round(avg(DISTINCT customer_id) + 1.3e-6, 2) AS a, min(customer_id) AS low FROM shop_orders", 2)
_add("agg_distinct_grouped", "SELECT category, COUNT(DISTINCT code) AS codes, COUNT(*) AS n FROM keyed GROUP BY category")
_add("agg_global_empty", "SELECT COUNT(*) AS n, COUNT(id) AS c, SUM(id) AS s, AVG(id) AS a, MIN(region) AS low, MAX(amount) AS high FROM sales WHERE id < 0", "SELECT count(*) AS n, count(id) AS c, CAST(sum(id) AS DOUBLE) AS s, avg(id) AS a, min(region) AS low, max(amount) AS high FROM sales WHERE id < 0")
_add("agg_grouped_empty", "SELECT region, COUNT(*) AS n FROM sales WHERE id < 0 GROUP BY region")
_add("minmax_str", "SELECT tier, MIN(name) AS first, MAX(name) AS last FROM customers GROUP BY tier")
_add("minmax_bool", "SELECT region, MIN(active) AS every, MAX(active) AS some FROM sales GROUP BY region")
_add("group_expr", "SELECT o_custkey / 100 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey / 100", "SELECT o_custkey // 100 AS bucket, count(*) AS n FROM orders GROUP BY o_custkey // 100")
_add("group_by_all", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ALL")
_add("group_no_agg", "SELECT category, code FROM keyed GROUP BY category, code")
_add("group_timestamp", "SELECT sold_at, COUNT(*) AS n FROM sales GROUP BY sold_at")
_add("having", "SELECT customer_id, COUNT(*) AS n FROM sales GROUP BY customer_id HAVING n > 20", "SELECT customer_id, count(*) AS n FROM sales GROUP BY customer_id HAVING count(*) > 20")
_add("agg_expr_arg", "SELECT l_linestatus, SUM(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY l_linestatus", 2)
# order, limit, top-k
_add("sort_desc_nulls", "SELECT id, amount FROM sales ORDER BY amount DESC, id LIMIT 40", "SELECT id, amount FROM sales ORDER BY amount DESC NULLS FIRST, id LIMIT 40")
_add("sort_asc_nulls", "SELECT row_id, code FROM keyed ORDER BY code, row_id LIMIT 40", "SELECT row_id, code FROM keyed ORDER BY code ASC NULLS LAST, row_id LIMIT 40")
_add("sort_nulls_given", "SELECT row_id, category, code FROM keyed ORDER BY category NULLS FIRST, code DESC NULLS LAST, row_id LIMIT 40", "SELECT row_id, category, code FROM keyed ORDER BY category ASC NULLS FIRST, code DESC NULLS LAST, row_id LIMIT 40")
_add("full_sort", "SELECT id, amount AS value FROM sales ORDER BY value DESC, id", "SELECT id, round(amount, 6) AS value FROM sales ORDER BY amount DESC NULLS FIRST, id", 6)
_add("topk", "SELECT id, amount AS value FROM sales ORDER BY value DESC NULLS LAST, id LIMIT 100", "SELECT id, round(amount, 6) AS value FROM sales ORDER BY amount DESC NULLS LAST, id LIMIT 100", 6)
_add("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 100")


def _placed(name: str, sql: str, oracle: str, places: int | None = None) -> None:
    """A sorted query with each row's place in its output, so that comparing the rows compares the order."""
    QUERIES[name] = lambda spark, sf_dir: _rounded(numbered(_Lazy(spark, sf_dir).sql(sql).to_df(), "place"), places)
    SQL[name] = oracle


_placed(
    "sort_places",
    "SELECT id, loaded_at, amount AS value FROM sales ORDER BY value DESC, id, loaded_at",
    "SELECT id, loaded_at, round(amount, 6) AS value, row_number() OVER (ORDER BY amount DESC NULLS FIRST, id, loaded_at) - 1 AS place FROM sales",
    6,
)
_placed(
    "sort_places_given",
    "SELECT category, code, row_id FROM keyed ORDER BY category DESC NULLS LAST, code NULLS FIRST, row_id LIMIT 2000",
    "SELECT category, code, row_id, place FROM (SELECT *, row_number() OVER (ORDER BY category DESC NULLS LAST, code ASC NULLS FIRST, row_id) - 1 AS place FROM keyed) WHERE place < 2000",
)
_add("limit0", "SELECT id, region FROM sales LIMIT 0")
# joins
_add("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey")
_add("join_left_null_extended", "SELECT s.order_id, s.ordered_at, c.name FROM shop_orders s LEFT JOIN customers c ON s.customer_id = c.customer_id")
_add("join_null_keys", "SELECT a.row_id, b.row_id AS other FROM keyed a JOIN keyed b ON a.code = b.code AND a.row_id = b.row_id")
_add("join_compound", "SELECT a.row_id, b.amount FROM keyed a LEFT JOIN keyed b ON b.row_id = a.row_id AND a.category = b.category")
_add("join_expr_key", "SELECT r.r_name, n.n_name FROM region r JOIN nation n ON r.r_regionkey + 1 = n.n_regionkey + 0")
_add("join_filter", "SELECT s.id, c.tier, s.amount AS value FROM sales s JOIN customers c ON s.customer_id = c.customer_id WHERE s.amount > 50", "SELECT s.id, c.tier, round(s.amount, 6) AS value FROM sales s JOIN customers c ON s.customer_id = c.customer_id WHERE s.amount > 50", 6)
_add("join_group", "SELECT c.tier, COUNT(*) AS n FROM sales s JOIN customers c ON s.customer_id = c.customer_id GROUP BY c.tier")
_add("join_many_to_many", "SELECT o.o_orderpriority AS priority, COUNT(*) AS n, SUM(l.l_quantity) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority", "SELECT o.o_orderpriority AS priority, count(*) AS n, round(sum(l.l_quantity), 2) AS q FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority", 2)
_add("join_string_key", "SELECT d.doc_id, m.mix_name, m.weight FROM documents d JOIN mix_targets m ON d.source = m.source")
_add("join_star", "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_add("self_join", "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
_add("join_timestamp", "SELECT o.o_orderkey, COUNT(*) AS n FROM orders o JOIN lineitem l ON o.o_orderdate = l.l_shipdate AND o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")
_add("join_timestamp_left", "SELECT a.id, b.loaded_at FROM sales a LEFT JOIN sales b ON a.sold_at = b.loaded_at AND a.id = b.id")
_add("join_left_none", "SELECT n.n_name, c.name FROM nation n LEFT JOIN customers c ON n.n_name = c.name")
# the relation API, memory and other sources
_built(
    "relation_pipeline",
    lambda s: s.table("lineitem").filter((col("l_quantity") > 40.0) & col("l_shipdate").is_not_null()).aggregate([col("l_suppkey")], [count_star().alias("n"), agg("MAX", "l_extendedprice").alias("top")]).sort(SortKey(col("n"), False), SortKey(col("l_suppkey"))).limit(25),
    "SELECT l_suppkey, count(*) AS n, max(l_extendedprice) AS top FROM lineitem WHERE l_quantity > 40 GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 25",
)
_built(
    "relation_join",
    lambda s: s.table("supplier").join(s.table("nation"), "left", ["s_nationkey"], ["n_nationkey"]).project("s_suppkey", "n_name", (col("s_acctbal") * lit(2.0)).alias("double_balance")),
    "SELECT s_suppkey, n_name, s_acctbal * 2.0::DOUBLE AS double_balance FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
)


def _exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _Lazy(spark, sf_dir).table("keyed").exchange(12, "category", "code").project("category", "code").to_df()
    return placed.withColumn("place", F.spark_partition_id()).groupBy("category", "code").agg(F.count_distinct("place").alias("places"), F.count(F.lit(1)).alias("n"))


QUERIES["hash_exchange"] = _exchange
SQL["hash_exchange"] = "SELECT category, code, 1::BIGINT AS places, count(*) AS n FROM keyed GROUP BY category, code"


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _Lazy(spark, sf_dir)
    session.register_memory("a", [(1, 10), (1, 11), (2, None), (None, 30)], "id bigint, value bigint", 2)
    session.register_memory("b", [(1, 10), (1, 11), (3, 300), (None, 30)], "id bigint, value bigint", 3)
    return session.sql("SELECT a.id, a.value, b.value AS other FROM a LEFT JOIN b ON a.id = b.id").to_df()


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _Lazy(spark, sf_dir)
    path = f"{shared_dir(spark)}/quern-csv-{uuid.uuid4().hex}"
    session.table("part").to_df().write.option("header", True).csv(path)
    remember(spark, path)
    session.register_csv("part_csv", path)
    return session.sql("SELECT p_partkey, p_name, p_size, p_retailprice * 2 AS twice FROM part_csv WHERE p_size > 20").to_df()


class _Numbers(TableProvider):
    """Integers in four partitions; a partition knows its range."""

    def schema(self):
        return pa.schema([("n", pa.int64()), ("square", pa.int64())])

    def partition_count(self):
        return 4

    def scan_partition(self, partition):
        yield from self.scan_columns(partition, ["n", "square"], 1000)

    def scan_columns(self, partition, columns, batch_rows):
        n = np.arange(partition * 1000, (partition + 1) * 1000)
        yield pa.record_batch([pa.array(n if c == "n" else n * n) for c in columns], list(columns))

    def partition_bytes(self):
        return 16_000

    def partition_may_match(self, partition, filters):
        return all(not isinstance(f, GreaterThan) or f.attribute != ("n",) or (partition + 1) * 1000 - 1 > f.value for f in filters)


def _provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _Lazy(spark, sf_dir)
    session.register_table("numbers", _Numbers())
    return session.sql("SELECT n, square FROM numbers WHERE n > 2500").to_df()


QUERIES["csv_source"] = _csv
SQL["csv_source"] = "SELECT p_partkey, p_name, p_size, p_retailprice * 2 AS twice FROM part WHERE p_size > 20"
QUERIES["provider_source"] = _provider
SQL["provider_source"] = "SELECT n, n * n AS square FROM range(4000) t(n) WHERE n > 2500"
QUERIES["memory_source"] = _memory
SQL["memory_source"] = """SELECT a.id, a.value, b.value AS other FROM (VALUES (1::BIGINT, 10::BIGINT), (1, 11), (2, NULL), (NULL, 30)) a(id, value)
    LEFT JOIN (VALUES (1::BIGINT, 10::BIGINT), (1, 11), (3, 300), (NULL, 30)) b(id, value) ON a.id = b.id"""

"""Queries that hold the session itself, its results, limits and sources, against SQL.

Each runs something at the driver (a query, a plan, a command line) and gives
what came of it as rows, which the SQL works out from the tables.
"""

from __future__ import annotations

import contextlib
import io
import json
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import cli, sqlfront
from quern.errors import CancelledError, ResourceExhaustedError, UnsupportedError
from quern.expr import count_star
from quern.operators.materialize import remember, shared_dir
from quern.operators.numbering import numbered
from quern.session import CancellationToken, Session, SessionConfig

BY_REGION = "SELECT region, COUNT(*) AS n FROM sales WHERE id >= 100 GROUP BY region"


def _session(spark: SparkSession, sf_dir: str, *tables: str, config: SessionConfig | None = None) -> Session:
    session = Session(config, spark)
    for name in tables:
        session.register_file(name, f"{sf_dir}/{name}.parquet")
    return session


def _flags(spark: SparkSession, facts: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame(sorted(facts.items()), "fact string, holds boolean")


def _flags_sql(*facts: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({fact!r}, true)' for fact in facts)}) t(fact, holds)"


def _refused(run, error: type[Exception]) -> bool:
    try:
        run()
    except error:
        return True
    return False


def registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names ignore case, and the last registration of a name wins."""
    session = _session(spark, sf_dir, "nation", "region")
    session.register_frame("NATION", session.table("region").to_df())
    return session.sql("SELECT r_regionkey AS k, r_name AS name FROM Nation").to_df()


def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows brought to the driver and given back."""
    return spark.createDataFrame(_session(spark, sf_dir, "sales").execute_sql(BY_REGION).table)


def sort_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort sees the names of the SELECT list, and a number in it is a constant."""
    found = _session(spark, sf_dir, "keyed").sql("SELECT code AS row_id, row_id AS code FROM keyed ORDER BY 1 DESC, code LIMIT 500")
    return numbered(found.to_df(), "place")


def explain_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _session(spark, sf_dir, "sales").explain("SELECT id FROM sales WHERE id > 5 ORDER BY id LIMIT 3")
    logical, optimized, physical = text.split("\n== ")
    facts = {"names the scan": "Scan: sales" in logical, "names the filter": "Filter: (id > 5)" in logical, "is optimized": "LocalLimit 3" in optimized or "Limit 3" in optimized}
    return _flags(spark, facts | {"pushes the filter": "GreaterThan(id,5)" in physical, "fuses sort and limit": "TakeOrderedAndProject" in physical, "reads one column": "ReadSchema: struct<id:bigint>" in physical})


def metrics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a query: rows of the result, and rows that left its filter."""
    metrics = json.loads(_session(spark, sf_dir, "sales").execute_sql(BY_REGION).metrics.to_json())
    filtered = [o["values"]["numOutputRows"] for o in metrics["operators"] if o["name"] == "Filter"]
    return spark.createDataFrame([("result", metrics["output_rows"]), *(("filter", n) for n in filtered)], "counter string, n bigint")


def memory_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = _session(spark, sf_dir, "sales", config=SessionConfig(memory_limit_bytes=2000))
    return _flags(
        spark,
        {
            "a small result fits": small.execute_sql("SELECT COUNT(*) AS n FROM sales").row_count == 1,
            "a large result is refused": _refused(lambda: small.execute_sql("SELECT id, region FROM sales"), ResourceExhaustedError),
            "sorting more than the limit spills": small.execute_sql("SELECT id, amount FROM sales ORDER BY amount, id LIMIT 5").row_count == 5,
        },
    )


def cancellation(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, token = _session(spark, sf_dir, "sales"), CancellationToken()
    before = session.execute_sql(BY_REGION, token).row_count > 0
    token.cancel()
    return _flags(spark, {"runs until cancelled": before, "refused once cancelled": _refused(lambda: session.execute_sql(BY_REGION, token), CancelledError), "others go on": session.execute_sql(BY_REGION).row_count > 0})


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _session(spark, sf_dir, "sales")
    texts = ["SELECT DISTINCT id FROM sales", "SELECT id FROM sales UNION SELECT id FROM sales", "SELECT id FROM sales LIMIT 1 OFFSET 1", "SELECT upper(region) AS u FROM sales", "SELECT COUNT(*) OVER () AS n FROM sales"]
    return _flags(spark, {text: _refused(lambda text=text: session.sql(text), UnsupportedError) for text in texts})


def config_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = SessionConfig(batch_size=0, channel_capacity=0, workers=0, memory_limit_bytes=0)
    default = SessionConfig()
    return spark.createDataFrame(
        [("clamped", config.batch_size, config.channel_capacity, config.memory_limit_bytes), ("default", default.batch_size, default.channel_capacity, default.memory_limit_bytes)],
        "kind string, batch_size bigint, channel_capacity bigint, memory_limit_bytes bigint",
    )


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that the command line prints, read back."""
    out = io.StringIO()
    sql = "SELECT n.n_name AS nation, r.r_name AS region FROM nation n LEFT JOIN other r ON n.n_regionkey = r.r_regionkey ORDER BY nation"
    with contextlib.redirect_stdout(out):
        code = cli.main(["--input", f"{sf_dir}/nation.parquet", "--table", "nation", "--register", f"other={sf_dir}/region.parquet", "--sql", sql], spark)
    rows = [[cell.strip() for cell in line.strip("|").split("|")] for line in out.getvalue().splitlines() if line.startswith("|")]
    return spark.createDataFrame([(*row, code) for row in rows[1:]], ", ".join(f"{name} string" for name in rows[0]) + ", code int")


def csv_given_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _session(spark, sf_dir, "part")
    path = f"{shared_dir(spark)}/quern-csv-{uuid.uuid4().hex}"
    session.table("part").to_df().write.option("header", True).csv(path)
    remember(spark, path)
    session.register_csv("part_csv", path, session.table("part").to_df().schema)
    return session.sql("SELECT p_brand, COUNT(*) AS n, MIN(p_name) AS first, MAX(p_size) AS largest FROM part_csv GROUP BY p_brand").to_df()


def exchange_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sent through an exchange with more places than keys, and through a second one, are the same rows."""
    there = _session(spark, sf_dir, "keyed").table("keyed").exchange(64, "category").exchange(3, "row_id")
    return there.aggregate(["category", "code"], [count_star().alias("n")]).to_df()


def plan_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate is worked out in two stages with an exchange between them, partial states before it."""
    result = _session(spark, sf_dir, "sales").execute_sql(BY_REGION)
    partial, final = (sum("HashAggregate" in o.name for o in result.metrics.operators) == 2, result.stages)
    return spark.createDataFrame([(result.distributed, final, partial)], "distributed boolean, stages bigint, partial_and_final boolean")


def plan_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parsed query is plain data: it can be sent elsewhere and built there."""
    text = "SELECT s.region AS r, COUNT(*) AS n, MIN(c.tier) AS t FROM sales s LEFT JOIN customers c ON s.customer_id = c.customer_id WHERE s.amount > 10 GROUP BY s.region HAVING n > 3"
    query = pickle.loads(pickle.dumps(sqlfront.parse(text)))
    return sqlfront.build(query, _session(spark, sf_dir, "sales", "customers").table).to_df()


def worker_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a stage behind an exchange, as they report themselves: how many, how many places, whether any was repeated, rows."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, rows = TaskContext.get(), sum(b.num_rows for b in batches)
        yield pa.record_batch([pa.array([context.partitionId()], pa.int32()), pa.array([context.attemptNumber()], pa.int32()), pa.array([rows], pa.int64())], ["place", "attempt", "rows"])

    placed = _session(spark, sf_dir, "keyed").table("keyed").exchange(12, "category", "code").to_df()
    tasks = placed.mapInArrow(report, "place int, attempt int, rows bigint")
    return tasks.agg(F.count("*").alias("tasks"), F.count_distinct("place").alias("places"), F.max("attempt").alias("repeated"), F.sum("rows").alias("rows"))


_REGIONS = "SELECT region, count(*) AS n FROM sales WHERE id >= 100 GROUP BY region"

QUERIES = {
    f.__name__: f
    for f in (registration, result_sink, sort_scope, explain_parts, metrics_rows, memory_limit, cancellation, refusals, config_clamps, command_line, csv_given_schema, exchange_round_trip, plan_reported, plan_shipped, worker_tasks)
}

SQL = {
    "registration": "SELECT r_regionkey AS k, r_name AS name FROM region",
    "result_sink": _REGIONS,
    "sort_scope": "SELECT code AS row_id, row_id AS code, place FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS place FROM keyed) WHERE place < 500",
    "explain_parts": _flags_sql("names the scan", "names the filter", "is optimized", "pushes the filter", "fuses sort and limit", "reads one column"),
    "metrics_rows": f"SELECT 'result' AS counter, count(*) AS n FROM ({_REGIONS}) UNION ALL SELECT 'filter', count(*) FROM sales WHERE id >= 100",
    "memory_limit": _flags_sql("a small result fits", "a large result is refused", "sorting more than the limit spills"),
    "cancellation": _flags_sql("runs until cancelled", "refused once cancelled", "others go on"),
    "refusals": _flags_sql("SELECT DISTINCT id FROM sales", "SELECT id FROM sales UNION SELECT id FROM sales", "SELECT id FROM sales LIMIT 1 OFFSET 1", "SELECT upper(region) AS u FROM sales", "SELECT COUNT(*) OVER () AS n FROM sales"),
    "config_clamps": "SELECT * FROM (VALUES ('clamped', 1::BIGINT, 1::BIGINT, 1::BIGINT), ('default', 8192, 2, 536870912)) t(kind, batch_size, channel_capacity, memory_limit_bytes)",
    "command_line": "SELECT n_name AS nation, r_name AS region, 0::INT AS code FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "csv_given_schema": "SELECT p_brand, count(*) AS n, min(p_name) AS first, max(p_size) AS largest FROM part GROUP BY p_brand",
    "exchange_round_trip": "SELECT category, code, count(*) AS n FROM keyed GROUP BY category, code",
    "plan_shipped": "SELECT s.region AS r, count(*) AS n, min(c.tier) AS t FROM sales s LEFT JOIN customers c ON s.customer_id = c.customer_id WHERE s.amount > 10 GROUP BY s.region HAVING count(*) > 3",
    "worker_tasks": "SELECT 12::BIGINT AS tasks, 12::BIGINT AS places, 0::INT AS repeated, count(*) AS rows FROM keyed",
    "plan_reported": "SELECT true AS distributed, 2::BIGINT AS stages, true AS partial_and_final",
}

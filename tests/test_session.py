"""Sources, explain, metrics, cancellation, limits, plans and the command line."""

import json
import threading
import time
from datetime import datetime

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

from quern import CancellationToken, Kind, Relation, Session, SessionConfig, SortKey, agg, col, count_star, lit
from quern.cli import main
from quern.errors import CancelledError, ExecutionError, NotFoundError, PlanningError, ResourceExhaustedError, UnsupportedError
from quern.sources.provider import TableProvider


@pytest.fixture
def files(tmp_path):
    (tmp_path / "orders.csv").write_text("order_id,customer_id,amount\n1,10,12.0\n2,20,30.0\n3,10,8.0\n4,99,50.0\n")
    (tmp_path / "customers.csv").write_text("customer_id,name\n10,Ada\n20,Grace\n")
    sales = pa.table({"id": pa.array(range(6), pa.int64()), "region": ["east", "west"] * 3, "amount": [float(i) for i in range(6)]})
    pq.write_table(sales, tmp_path / "sales.parquet", row_group_size=2)
    pq.write_table(pa.table({"value": pa.array([None, None, 1, None, 2, 3], pa.int64())}), tmp_path / "nullable.pq", row_group_size=2)
    return tmp_path


def test_csv(session, files):
    session.register_csv("orders", files / "orders.csv")
    result = session.execute_sql("SELECT order_id, amount FROM orders WHERE amount > 10 ORDER BY order_id")
    assert result.rows() == [(1, 12.0), (2, 30.0), (4, 50.0)]
    assert [str(f.type) for f in result.table.schema] == ["int32", "double"]


def test_csv_join_needs_like_key_types(session, files):
    session.register_file("orders", files / "orders.csv")
    session.register_file("customers", files / "customers.csv")
    rows = session.execute_sql("SELECT o.order_id, c.name FROM orders o LEFT JOIN customers c ON o.customer_id = c.customer_id ORDER BY o.order_id").rows()
    assert rows == [(1, "Ada"), (2, "Grace"), (3, "Ada"), (4, None)]


def test_csv_types_given_inferred_or_refused(session, tmp_path):
    (tmp_path / "x.csv").mkdir()
    for part, rows in enumerate(["1,a\n2,b\n", "3,c\n4.5,d\n"]):
        (tmp_path / "x.csv" / f"{part}.csv").write_text("n,s\n" + rows)
    path = tmp_path / "x.csv"
    session.register_csv("given", path, "n DOUBLE, s STRING")
    assert session.execute_sql("SELECT SUM(n) AS t FROM given").rows() == [(10.5,)]
    session.register_csv("whole", path, infer_rows=None)
    assert session.execute_sql("SELECT MAX(n) AS t FROM whole").rows() == [(4.5,)]
    session.register_csv("some", path, infer_rows=4)  # a header line of the second file is no row
    assert dict(session.table("some").to_df().dtypes) == {"n": "double", "s": "string"}
    session.register_csv("one", path, infer_rows=1)
    assert dict(session.table("one").to_df().dtypes) == {"n": "int", "s": "string"}
    with pytest.raises(ExecutionError):
        session.execute_sql("SELECT MAX(n) AS t FROM one")
    assert session.execute_sql("SELECT COUNT(s) AS t FROM one").rows() == [(4,)]
    with pytest.raises(NotFoundError):
        session.register_csv("no", tmp_path / "no.csv")
    (tmp_path / "empty.csv").write_text("a,b\n")
    session.register_csv("empty", tmp_path / "empty.csv")
    assert session.execute_sql("SELECT a, b FROM empty").columns == ["a", "b"]


def test_parquet_pushdown_and_pruned_columns(session, files):
    session.register_file("sales", files / "sales.parquet")
    frame = session.sql("SELECT region FROM sales WHERE id >= 4").to_df()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,4)" in plan and "ReadSchema: struct<id:bigint,region:string>" in plan
    assert [r[0] for r in frame.collect()] == ["east", "west"]


def test_parquet_row_groups_without_nulls_or_matches(session, files):
    session.register_file("nullable", files / "nullable.pq")
    assert session.execute_sql("SELECT COUNT(*) AS n FROM nullable WHERE value IS NULL").rows() == [(3,)]
    assert session.execute_sql("SELECT value FROM nullable WHERE value > 100").rows() == []


def test_a_parquet_file_that_changes_is_read_anew(session, tmp_path):
    path = tmp_path / "x.parquet"
    for table, want in ((pa.table({"a": [1, 2]}), [(1,), (2,)]), (pa.table({"b": ["x"]}), [("x",)])):
        pq.write_table(table, path)
        for _ in range(2):
            session.register_parquet("x", path)
            assert session.execute_sql("SELECT * FROM x").rows() == want


def test_missing_and_unknown_files(session, tmp_path):
    with pytest.raises(NotFoundError):
        session.register_parquet("x", tmp_path / "no.parquet")
    with pytest.raises(PlanningError):
        session.register_file("x", tmp_path / "x.json")


def test_memory_forms(session):
    session.register_memory("p", pd.DataFrame({"a": [1, 2]}))
    session.register_memory("b", [pa.record_batch({"a": [1]}), pa.record_batch({"a": [2]})])
    session.register_memory("e", [], pa.schema([("a", pa.int64())]))
    counts = [session.execute_sql(f"SELECT COUNT(*) AS n FROM {t}").rows()[0][0] for t in "pbe"]
    assert counts == [2, 2, 0]
    with pytest.raises(PlanningError):
        session.register_memory("x", [pa.record_batch({"a": [1]}), pa.record_batch({"b": [2]})])
    rows = [(1, None, float("nan"), "x", True), [None, 2, 1.5, None, None]]
    session.register_memory("m", rows, "a bigint, b int, c double, d string, e boolean", 2)
    frame = session.table("m").to_df()
    assert [tuple(map(repr, r)) for r in frame.collect()] == [tuple(map(repr, r)) for r in rows] and frame.rdd.getNumPartitions() == 2
    assert "LocalTableScan" in frame._jdf.queryExecution().executedPlan().toString()
    session.register_memory("t", [(datetime(2024, 1, 1), {"k": 1})], "at timestamp_ntz, m map<string,int>", 50)  # not plain: Spark's own conversion
    assert session.table("t").to_df().collect()[0]["m"] == {"k": 1}
    with pytest.raises(Exception, match="CANNOT_ACCEPT|can not accept|FIELD_DATA_TYPE"):
        session.register_memory("bad", [("x",)], "a bigint")


def test_a_join_of_small_local_tables_needs_no_shuffle(session):
    session.register_memory("l", [(i,) for i in range(2000)], "id bigint", 4)
    session.register_memory("r", [(i,) for i in range(0, 2000, 2)], "id bigint", 4)
    frame = session.sql("SELECT l.id FROM l JOIN r ON l.id = r.id").to_df()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and frame.count() == 1000


def test_last_registration_wins_and_names_ignore_case(session):
    session.register_memory("T", [(1,)], "a bigint")
    session.register_memory("t", [(2,)], "a bigint")
    assert session.execute_sql("SELECT a FROM T").rows() == [(2,)] and session.tables == ["t"]


class Ranges(TableProvider):
    def schema(self):
        return pa.schema([("n", pa.int64()), ("part", pa.string())])

    def partition_count(self):
        return 3

    def scan_partition(self, partition):
        if partition == 0:
            raise AssertionError("should have been skipped")
        yield pa.record_batch({"n": pa.array([partition * 10, partition * 10 + 1], pa.int64()), "part": [f"p{partition}"] * 2})

    def partition_may_match(self, partition, filters):
        return not any((isinstance(f, GreaterThanOrEqual) and partition * 10 + 1 < f.value) or (isinstance(f, EqualTo) and f.attribute == ("n",) and f.value // 10 != partition) for f in filters)


def test_provider_skips_partitions(session):
    session.register_table("r", Ranges())
    assert sorted(session.execute_sql("SELECT n, part FROM r WHERE n >= 11").rows()) == [(11, "p1"), (20, "p2"), (21, "p2")]


class Wide(TableProvider):
    def __init__(self, promised=None):
        self.promised = promised

    def schema(self):
        return pa.schema([("n", pa.int64()), ("half", pa.float64()), ("text", pa.string())])

    def partition_count(self):
        return 2

    def scan_partition(self, partition):
        raise AssertionError("all columns were asked for")

    def scan_columns(self, partition, columns, batch_rows):
        made = {"n": lambda i: i, "half": lambda i: i / 2}  # text can't be made
        yield pa.record_batch({c: pa.array([made[c](i) for i in range(partition * 5, partition * 5 + 5)], self.schema().field(c).type) for c in columns})

    def partition_bytes(self):
        return self.promised


def test_provider_gets_the_columns_of_the_query(session):
    session.register_table("w", Wide())
    assert session.execute_sql("SELECT SUM(w.half) AS s FROM w WHERE n > 3").rows() == [(19.5,)]
    assert session.execute_sql("SELECT COUNT(*) AS n FROM w").rows() == [(10,)]
    assert session.execute(session.table("w", columns=["n"]).sort("n").limit(1)).rows() == [(0,)]
    with pytest.raises(ExecutionError):
        session.execute_sql("SELECT * FROM w")


def test_provider_size_is_promised_and_checked(session):
    session.register_table("big", Ranges())
    session.register_memory("m", [(i,) for i in range(3000)], "n bigint")
    plans = {}
    for promised in (None, 1000, 1 << 30, 10):
        session.register_table("w", Wide(promised))
        query = "SELECT m.n, w.half FROM m JOIN w ON m.n = w.n"
        plans[promised] = session.sql(query).to_df()._jdf.queryExecution().optimizedPlan().toString()
        if promised == 10:
            with pytest.raises(ExecutionError, match="promises"):
                session.execute_sql(query)
        else:
            assert session.execute_sql(query).row_count == 10
    assert [("broadcast" in plan) for plan in plans.values()] == [False, True, False, True]


def test_explain_and_metrics(session):
    session.register_memory("s", [(i, i % 3) for i in range(30)], "id bigint, g bigint")
    text = session.explain("SELECT g, COUNT(*) AS n FROM s WHERE id > 3 GROUP BY g ORDER BY n LIMIT 2")
    assert [part in text for part in ("== Logical plan ==", "== Optimized plan ==", "== Physical plan ==", "Limit: 2", "Filter: (id > 3)", "TakeOrderedAndProject")] == [True] * 6
    result = session.execute_sql("SELECT g, COUNT(*) AS n FROM s GROUP BY g")
    assert result.row_count == 3 and result.distributed and result.stages == 2
    metrics = json.loads(result.metrics.to_json())
    assert metrics["output_rows"] == 3 and metrics["elapsed_ms"] > 0
    assert any(o["name"] == "HashAggregate" and o["values"].get("numOutputRows") == 3 for o in metrics["operators"])
    assert "| g | n  |" in result.pretty()


def test_aggregate_is_partial_before_the_exchange(session):
    session.register_memory("s", [(1, 2)], "g bigint, x bigint")
    plan = session.sql("SELECT g, MAX(x) AS m FROM s GROUP BY g").to_df()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.index("Exchange") < plan.index("partial_max")


def test_memory_limit(spark):
    session = Session(SessionConfig(memory_limit_bytes=100), spark)
    session.register_memory("s", [(i,) for i in range(1000)], "id bigint")
    assert session.execute_sql("SELECT COUNT(*) AS n FROM s").rows() == [(1000,)]
    with pytest.raises(ResourceExhaustedError):
        session.execute_sql("SELECT id FROM s")


def test_fetching_stops_at_the_limit(spark):
    session, began = Session(SessionConfig(memory_limit_bytes=100_000), spark), time.time()
    session.register_table("endless", Endless())
    with pytest.raises(ResourceExhaustedError):
        session.execute_sql("SELECT n FROM endless")
    assert time.time() - began < 100  # the other partitions would take 40 minutes
    assert session.execute_sql("SELECT n FROM endless WHERE n < 5").row_count == 5


class Endless(TableProvider):
    """One large partition, and others that take their time."""

    def schema(self):
        return pa.schema([("n", pa.int64())])

    def partition_count(self):
        return 160

    def scan_partition(self, partition):
        if partition:
            time.sleep(60)
        yield pa.record_batch({"n": pa.array(range(50_000 if not partition else 1), pa.int64())})

    def partition_may_match(self, partition, filters):
        return partition == 0 or not filters


def test_settings_of_a_running_session(spark):
    batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batches)
    try:
        assert SessionConfig(batch_size=77).start() is spark and spark.conf.get(batches) == "77"
        for config in (SessionConfig(master="spark://elsewhere:7077"), SessionConfig(workers=3)):
            with pytest.raises(PlanningError):
                config.start()
        assert SessionConfig(workers=4, master="local[4]").start() is spark
    finally:
        spark.conf.set(batches, before)
        spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(PlanningError, match="ansi"):
            Session(spark=spark)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_one_distinct_expression_needs_no_expand(session):
    session.register_memory("s", [(1, 5, 2.0), (1, 5, 2.0), (1, None, 3.0), (2, -7, None)], "g bigint, x bigint, y double")
    sql = "SELECT g, COUNT(DISTINCT x) AS n, SUM(DISTINCT x) AS s, AVG(DISTINCT x) AS a, COUNT(x) AS c, SUM(y) AS t FROM s GROUP BY g"
    assert "Expand" not in session.explain(sql)
    assert sorted(session.execute_sql(sql).rows()) == [(1, 1, 5.0, 5.0, 2, 7.0), (2, 1, -7.0, -7.0, 1, None)]


def test_config_clamps():
    config = SessionConfig(batch_size=0, channel_capacity=0, workers=0, memory_limit_bytes=0)
    assert (config.batch_size, config.channel_capacity, config.workers, config.memory_limit_bytes) == (1, 1, 1, 1)


class Slow(TableProvider):
    def schema(self):
        return pa.schema([("n", pa.int64())])

    def partition_count(self):
        return 1

    def scan_partition(self, partition):
        time.sleep(60)
        yield pa.record_batch({"n": pa.array([1], pa.int64())})


def test_cancellation(session):
    token = CancellationToken()
    token.cancel()
    session.register_memory("s", [(1,)], "id bigint")
    with pytest.raises(CancelledError):
        session.execute_sql("SELECT id FROM s", token)
    session.register_table("slow", Slow())
    token, began = CancellationToken(), time.time()
    threading.Timer(3, token.cancel).start()
    with pytest.raises(CancelledError):
        session.execute_sql("SELECT n FROM slow", token)
    assert time.time() - began < 50


def test_relations(session):
    session.register_memory("s", [(1, "a", 2.0), (2, "b", None)], "id bigint, g string, x double")
    s = session.table("s")
    built = s.filter((col("id") >= 1) & col("g").is_not_null()).aggregate(["g"], [count_star().alias("n"), agg("sum", col("x") * lit(2.0)).alias("t")]).sort(SortKey(col("g"), ascending=False))
    assert session.execute(built).rows() == [("b", 1, None), ("a", 1, 4.0)]
    assert session.execute(s.project("*", (col("id") / 2).alias("half"), col("id").cast(Kind.UTF8).alias("t")).sort("id")).rows() == [(1, "a", 2.0, 0, "1"), (2, "b", None, 1, "2")]
    same = Relation.scan(session.spark.createDataFrame([(1,)], "id bigint"), "s")
    assert session.execute(same.join(same, "inner", ["id"], ["id"])).columns == ["id", "right.id"]
    for bad in (lambda: s.limit(-1), lambda: s.join(s, "inner", [], []), lambda: s.project(), lambda: s.sort()):
        with pytest.raises(PlanningError):
            bad()
    with pytest.raises(UnsupportedError):
        s.limit(1 << 31)
    with pytest.raises(UnsupportedError):
        s.join(s, "full", ["id"], ["id"])


def test_other_types_pass_through(session):
    frame = session.spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS t, 1.50BD AS d, array(1, 2) AS a, date'2024-01-01' AS day")
    session.register_frame("o", frame)
    assert session.execute_sql("SELECT t, MAX(d) AS d, COUNT(a) AS n FROM o WHERE t = t GROUP BY t").row_count == 1
    with pytest.raises(PlanningError):
        session.sql("SELECT t > day AS x FROM o")


def test_odd_column_names(session):
    session.register_frame("o", session.spark.sql("SELECT 1L AS `a b`, 2L AS `c``d`, 3L AS `select`"))
    assert session.execute_sql('SELECT "a b", "c`d", `select` FROM o').rows() == [(1, 2, 3)]


def test_stream(session, tmp_path):
    from quern.streaming.files import register_stream, start

    folder = tmp_path / "in"
    frame = session.spark.createDataFrame([(1, 2.0), (2, 5.0)], "id bigint, x double")
    frame.write.parquet(str(folder))
    register_stream(session, "live", str(folder), frame.schema)
    start(session.sql("SELECT id FROM live WHERE x > 3"), "parquet", str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert [r[0] for r in session.spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
    start(session.sql("SELECT COUNT(*) AS n, SUM(x) AS s FROM live"), "memory", "totals", str(tmp_path / "c2"), complete=True).awaitTermination(120)
    assert [tuple(r) for r in session.spark.table("totals").collect()] == [(2, 7.0)]


def test_command_line(files, capsys, spark):
    sql = "SELECT o.order_id, c.name FROM orders o LEFT JOIN customers c ON o.customer_id = c.customer_id ORDER BY o.order_id"
    args = ["--input", str(files / "orders.csv"), "--table", "orders", "--register", f"customers={files / 'customers.csv'}", "--sql", sql]
    assert main([*args, "--show-plan", "--metrics"]) == 0
    out, err = capsys.readouterr()
    assert "| 4        |       |" in out and "== Physical plan ==" in out and json.loads(err)["output_rows"] == 4
    assert main([*args, "--explain"]) == 0 and "Left join" in capsys.readouterr().out
    assert main(["--sql", "SELECT 1 AS x FROM nowhere"]) == 1 and "nowhere" in capsys.readouterr().err
    assert main(["--register", "bad", "--sql", "SELECT 1 AS x FROM bad"]) == 1
    typed = ["--input", str(files / "orders.csv"), "--table", "o", "--schema", "order_id BIGINT, customer_id STRING, amount DOUBLE", "--sql", "SELECT customer_id, order_id FROM o WHERE customer_id = '99'"]
    assert main(typed, spark) == 0 and "| 99          | 4        |" in capsys.readouterr().out
    assert main([*args, "--infer-rows", "0"], spark) == 0 and "Grace" in capsys.readouterr().out
    assert main([*args, "--workers", "3"]) == 1 and "workers" in capsys.readouterr().err

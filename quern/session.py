"""Session: configuration, catalog, queries, results and cancellation."""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Collection
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.errors.exceptions.captured import unwrap_spark_exception
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.serializers import ArrowCollectSerializer
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.util import _load_from_socket

from quern import sqlfront
from quern.errors import CancelledError, ExecutionError, NotFoundError, PlanningError, QuernError, ResourceExhaustedError
from quern.metrics import QueryMetrics, operators
from quern.relation import Relation
from quern.sources.files import INFER_ROWS, read_csv, read_parquet
from quern.sources.memory import memory_frame
from quern.sources.provider import TableProvider, provider_frame

DEFAULT_MEMORY_LIMIT_BYTES = 512 << 20
DEFAULT_BATCH_ROWS = 8192

#: What the engine's semantics need of a Spark session: errors on overflow and on integer division by zero.
NEEDED = {"spark.sql.ansi.enabled": "true"}

#: What a Session sets where Spark's default differs: filters reach sources written in Python.
RUNTIME = {"spark.sql.python.filterPushdown.enabled": "true"}


@dataclass
class SessionConfig:
    """Settings of a session; numbers below one count as one.

    ``batch_size`` sets the rows of Spark's columnar batches and Arrow batches,
    ``workers`` the local threads where the session starts Spark itself.
    Where Spark runs already, a batch size other than the default is set there,
    and ``master`` or ``workers`` that contradict it are an error.
    ``memory_limit_bytes`` bounds the result that a query may hand to the
    driver: fetching stops as soon as it is exceeded. Inside the cluster Spark
    spills instead of failing.
    ``channel_capacity`` and ``distributed`` are kept for callers that set
    them: Spark pipelines by itself, and every plan is distributed.
    """

    batch_size: int = DEFAULT_BATCH_ROWS
    channel_capacity: int = 2
    workers: int = field(default_factory=lambda: os.cpu_count() or 1)
    distributed: bool = False
    memory_limit_bytes: int = DEFAULT_MEMORY_LIMIT_BYTES
    master: str | None = None

    def __post_init__(self) -> None:
        for name in ("batch_size", "channel_capacity", "workers", "memory_limit_bytes"):
            setattr(self, name, max(1, getattr(self, name)))

    def start(self) -> SparkSession:
        """The running Spark session, or a new one with these settings."""
        running = SparkSession.getActiveSession()
        batches = dict.fromkeys(("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"), str(self.batch_size))
        if running is not None:
            self._agree(running.conf.get("spark.master", ""))
            if self.batch_size != DEFAULT_BATCH_ROWS:
                for name, value in batches.items():
                    running.conf.set(name, value)
            return running
        builder = SparkSession.builder.appName("quern").master(self.master or f"local[{self.workers}]")
        settings = {"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", **batches}
        if not self.master:
            settings["spark.sql.shuffle.partitions"] = str(self.workers)
        return builder.config(map=settings).getOrCreate()


    def _agree(self, master: str) -> None:
        """Settings that can't change while Spark runs must be left alone or name what is there."""
        if self.master not in (None, master):
            raise PlanningError(f"Spark runs on {master} already; it can't be moved to {self.master}")
        threads = master.removeprefix("local[").removesuffix("]")
        if self.workers != (os.cpu_count() or 1) and threads.isdigit() and int(threads) != self.workers:
            raise PlanningError(f"Spark runs with {threads} threads already; it can't have {self.workers} workers")


class CancellationToken:
    """Stops the queries that were started with it."""

    def __init__(self) -> None:
        self._tag, self._cancelled, self._spark = f"quern-{uuid.uuid4().hex}", False, None

    @property
    def cancelled(self) -> bool:
        return self._cancelled

    def cancel(self) -> None:
        """May be called from any thread, before or while a query runs."""
        self._cancelled = True
        if self._spark is not None:
            threading.Thread(target=self._stop_jobs, daemon=True).start()

    def _stop_jobs(self) -> None:
        # a query that is still being planned has no job yet, and one may have several
        while (spark := self._spark) is not None:
            spark.sparkContext.cancelJobsWithTag(self._tag)
            time.sleep(0.2)

    def _enter(self, spark: SparkSession) -> None:
        if self._cancelled:
            raise CancelledError("the query was cancelled before it began")
        self._spark = spark
        spark.sparkContext.addJobTag(self._tag)
        spark.sparkContext.setInterruptOnCancel(True)

    def _leave(self, spark: SparkSession) -> None:
        self._spark = None
        spark.sparkContext.removeJobTag(self._tag)
        spark.sparkContext.setInterruptOnCancel(False)


@dataclass
class QueryResult:
    """A finished query: its rows as Arrow batches, the texts of its plans, and its metrics."""

    table: pa.Table
    metrics: QueryMetrics
    logical_plan: str
    optimized_plan: str
    physical_plan: str
    distributed: bool
    stages: int
    cleanup_errors: list[str] = field(default_factory=list)
    recovery_attempts: int = 0

    @property
    def batches(self) -> list[pa.RecordBatch]:
        return self.table.to_batches()

    @property
    def row_count(self) -> int:
        return self.table.num_rows

    @property
    def columns(self) -> list[str]:
        return self.table.column_names

    def rows(self) -> list[tuple]:
        return list(zip(*(c.to_pylist() for c in self.table.columns), strict=True))

    def pretty(self) -> str:
        """The rows in a text table."""
        cells = [[("" if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for v in row] for row in self.rows()]
        widths = [max(map(len, [name, *(row[i] for row in cells)])) for i, name in enumerate(self.columns)]
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        line = lambda row: "|" + "|".join(f" {v:<{w}} " for v, w in zip(row, widths, strict=True)) + "|"
        return "\n".join([rule, line(self.columns), rule, *map(line, cells), *([rule] if cells else [])])


class Session:
    """The way in: register tables, then run SQL or relations.

    ``sql`` gives a lazy Relation, of which ``to_df()`` is a DataFrame to write
    or build on at any scale; ``execute_sql`` runs a query and brings its rows
    to the driver. ``spark`` is the underlying session, with all that Spark
    can do beyond this engine.
    """

    def __init__(self, config: SessionConfig | None = None, spark: SparkSession | None = None) -> None:
        self.config = config or SessionConfig()
        self.spark = spark or self.config.start()
        for name, value in NEEDED.items():
            if self.spark.conf.get(name) != value:
                raise PlanningError(f"the engine's arithmetic needs {name}={value}")
        for name, value in RUNTIME.items():
            self.spark.conf.set(name, value)
        self._tables: dict[str, DataFrame | TableProvider] = {}

    # catalog: names are case-insensitive, the last registration wins

    def register_frame(self, name: str, frame: DataFrame) -> None:
        self._tables[name.lower()] = frame

    def register_memory(self, name: str, data, schema: T.StructType | pa.Schema | str | None = None, partitions: int | None = None) -> None:
        """Rows, a pandas DataFrame, or Arrow tables and batches (all of one schema)."""
        self.register_frame(name, memory_frame(self.spark, data, schema, partitions))

    def register_csv(self, name: str, path: str | Path, schema: T.StructType | str | None = None, infer_rows: int | None = INFER_ROWS) -> None:
        """CSV with a header. Without a schema, types follow from the first ``infer_rows`` rows (None: all rows, read once more)."""
        self.register_frame(name, read_csv(self.spark, path, schema, infer_rows))

    def register_parquet(self, name: str, path: str | Path) -> None:
        self.register_frame(name, read_parquet(self.spark, path))

    def register_table(self, name: str, provider: TableProvider) -> None:
        """A source written in Python. A query reads only the columns that it names."""
        self._tables[name.lower()] = provider

    def register_file(self, name: str, path: str | Path, kind: str = "auto", schema: T.StructType | str | None = None, infer_rows: int | None = INFER_ROWS) -> None:
        """A CSV or Parquet file, told apart by its ending unless ``kind`` says which; schema and inference are for CSV."""
        if kind == "auto":
            kind = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}.get(Path(path).suffix.lower())
        if kind == "csv":
            self.register_csv(name, path, schema, infer_rows)
        elif kind == "parquet":
            self.register_parquet(name, path)
        else:
            raise PlanningError(f"can't tell the format of {path}; use .csv, .parquet or .pq")

    @property
    def tables(self) -> list[str]:
        return sorted(self._tables)

    def table(self, name: str, alias: str | None = None, columns: Collection[str] | None = None) -> Relation:
        """The scan of a registered table.

        ``columns``: the only ones that will be used, for sources written in
        Python; other sources find that out from the plan.
        """
        found = self._tables.get(name.lower())
        if found is None:
            raise NotFoundError(f"table '{name}' is not registered")
        if isinstance(found, TableProvider):
            found = provider_frame(self.spark, found, columns, self.config.batch_size)
        return Relation.scan(found, name, alias)

    # queries

    def sql(self, text: str) -> Relation:
        """The relation of one SELECT statement; nothing runs."""
        try:
            query = sqlfront.parse(text)
            return sqlfront.build(query, lambda name, alias: self.table(name, alias, query.columns()))
        except PySparkException as error:
            raise PlanningError(str(error)) from error

    def explain(self, query: str | Relation) -> str:
        """Three texts: the plan as written, as optimized, and as it would run."""
        relation = self.sql(query) if isinstance(query, str) else query
        optimized, physical = _plans(relation.to_df())
        return f"== Logical plan ==\n{relation.explain()}\n\n== Optimized plan ==\n{optimized}\n== Physical plan ==\n{physical}"

    def execute_sql(self, text: str, cancellation: CancellationToken | None = None) -> QueryResult:
        return self.execute(self.sql(text), cancellation)

    def execute(self, relation: Relation, cancellation: CancellationToken | None = None) -> QueryResult:
        """Run a relation and bring its rows to the driver."""
        frame, began = relation.to_df(), time.perf_counter()
        if cancellation:
            cancellation._enter(self.spark)
        try:
            table = bounded_fetch(frame, self.config.memory_limit_bytes)
        except QuernError:
            raise
        except Exception as error:
            if cancellation and cancellation.cancelled:
                raise CancelledError("the query was cancelled") from error
            if isinstance(error, PySparkException) or "py4j" in type(error).__module__:
                raise ExecutionError(str(error).split("JVM stacktrace")[0].strip()) from error
            raise
        finally:
            if cancellation:
                cancellation._leave(self.spark)
        if cancellation and cancellation.cancelled:
            raise CancelledError("the query was cancelled")
        elapsed = (time.perf_counter() - began) * 1000
        found = operators(frame)
        metrics = QueryMetrics(elapsed, table.num_rows, len(table.to_batches()), table.nbytes, found)
        optimized, physical = _plans(frame)
        exchanges = sum("Exchange" in o.name for o in found)
        return QueryResult(table, metrics, relation.explain(), optimized, physical, exchanges > 0, exchanges + 1)


def bounded_fetch(frame: DataFrame, limit: int) -> pa.Table:
    """The rows at the driver, batch by batch as tasks end; beyond ``limit`` bytes the rest is cancelled.

    Over Spark Connect, which has no such stream, the size is checked at the end.
    """

    def check(size: int) -> None:
        if size > limit:
            raise ResourceExhaustedError(f"the result has more than {limit} bytes, the limit: {size} were fetched")

    if not hasattr(frame, "_jdf"):
        table = frame.toArrow()
        check(table.nbytes)
        return table
    context, tag, size, found = frame.sparkSession.sparkContext, f"quern-fetch-{uuid.uuid4().hex}", 0, []
    context.addJobTag(tag)
    try:
        port, secret, server = frame._jdf.collectAsArrowToPython()
        try:
            for item in _load_from_socket((port, secret), ArrowCollectSerializer()):
                found.append(item)
                if isinstance(item, pa.RecordBatch):
                    size += item.nbytes
                    check(size)
        except ResourceExhaustedError:
            context.cancelJobsWithTag(tag)
            raise
        finally:
            if size <= limit:
                with unwrap_spark_exception():
                    server.getResult()
    finally:
        context.removeJobTag(tag)
    order = found.pop()  # comes after the batches
    schema = to_arrow_schema(frame.schema)
    return pa.Table.from_batches([found[i] for i in order]).cast(schema) if order else schema.empty_table()


def _plans(frame: DataFrame) -> tuple[str, str]:
    try:
        execution = frame._jdf.queryExecution()
    except AttributeError:  # Spark Connect
        return "", ""
    return execution.optimizedPlan().toString(), execution.executedPlan().toString()

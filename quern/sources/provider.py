"""Sources written in Python, read through Spark's Python data source API.

A TableProvider tells its schema and partitions and gives Arrow batches; Spark
runs one task a partition. A query's columns reach the provider, and the
filters that Spark offers are used to skip whole partitions and are applied
again afterwards.
"""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from collections.abc import Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from quern.errors import ResourceExhaustedError
from quern.operators.bounded import BROADCAST_BYTES

FILTERS = "spark.sql.python.filterPushdown.enabled"


class TableProvider(ABC):
    """A partitioned table. It is sent to the executors, so it must be picklable."""

    @abstractmethod
    def schema(self) -> pa.Schema: ...

    @abstractmethod
    def partition_count(self) -> int: ...

    @abstractmethod
    def scan_partition(self, partition: int) -> Iterator[pa.RecordBatch]:
        """The batches of one partition, with all columns of the schema."""

    def scan_columns(self, partition: int, columns: Sequence[str], batch_rows: int) -> Iterator[pa.RecordBatch]:
        """The batches of one partition with the named columns only, at best of ``batch_rows`` rows.

        Override it where leaving columns out saves work; this one drops them after the scan.
        """
        for batch in self.scan_partition(partition):
            yield batch.select(list(columns))

    def partition_may_match(self, partition: int, filters: Sequence[Filter]) -> bool:
        """False only if no row of the partition can pass all filters (see pyspark.sql.datasource)."""
        return True

    def partition_bytes(self) -> int | None:
        """A bound of each partition's Arrow bytes, if there is one.

        It is checked while reading, and a partition beyond it is an error; so
        a table whose partitions together can't be large is broadcast where it
        is joined.
        """
        return None


def provider_frame(spark: SparkSession, provider: TableProvider, columns: Collection[str] | None = None, batch_rows: int = 8192) -> DataFrame:
    """The table as a DataFrame of all columns, or of those named (one at least); unknown names are passed over.

    Filters reach the provider where Spark's ``spark.sql.python.filterPushdown.enabled`` is on, as a Session has it.
    """
    name, whole = f"quern_{uuid.uuid4().hex}", provider.schema()
    used = [f.name for f in whole if columns is None or f.name in columns] or whole.names[:1]
    schema = from_arrow_schema(pa.schema([whole.field(c) for c in used]))
    promised = provider.partition_bytes()

    class Reader(DataSourceReader):
        filters: Sequence[Filter] = ()

        def partitions(self):
            return [InputPartition(i) for i in range(provider.partition_count()) if provider.partition_may_match(i, self.filters)]

        def read(self, partition):
            if partition is None or partition.value is None:  # no partition is left
                return
            size = 0
            for batch in provider.scan_columns(partition.value, used, batch_rows):
                size += batch.nbytes
                if promised is not None and size > promised:
                    raise ResourceExhaustedError(f"partition {partition.value} has more than the {promised} bytes that its table promises")
                for at in range(0, batch.num_rows, batch_rows):
                    yield batch.slice(at, batch_rows)

    class FilteringReader(Reader):
        def pushFilters(self, filters):  # noqa: N802 (Spark's name)
            self.filters = list(filters)
            return self.filters  # all are applied again by Spark

    filtering = spark.conf.get(FILTERS) == "true"

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return FilteringReader() if filtering else Reader()

    spark.dataSource.register(Source)
    frame = spark.read.format(name).load()
    small = promised is not None and promised * provider.partition_count() <= BROADCAST_BYTES
    return frame.hint("broadcast") if small else frame

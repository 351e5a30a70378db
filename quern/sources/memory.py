"""Tables held by the driver's program."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.errors import PlanningError
from quern.types import UNSIGNED_MARK


def memory_frame(spark: SparkSession, data, schema: T.StructType | pa.Schema | str | None = None, partitions: int | None = None) -> DataFrame:
    """A DataFrame of rows, a pandas DataFrame, or Arrow data of one schema.

    Unsigned Arrow columns are widened to types that hold all their values and
    marked, so that the engine's rules for unsigned numbers apply.
    """
    if isinstance(data, (pa.RecordBatch, pa.Table)):
        data = [data]
    if isinstance(schema, pa.Schema) or (isinstance(data, Sequence) and data and isinstance(data[0], (pa.RecordBatch, pa.Table))):
        tables = [pa.Table.from_batches([x]) if isinstance(x, pa.RecordBatch) else x for x in data]
        wanted = schema if isinstance(schema, pa.Schema) else tables[0].schema
        for table in tables:
            if table.schema != wanted:
                raise PlanningError("all batches of a table must have its schema")
        frame = _from_arrow(spark, pa.concat_tables(tables) if tables else wanted.empty_table())
    elif (table := _as_arrow(spark, data, schema)) is not None:
        frame = _from_arrow(spark, table)
    else:
        frame = spark.createDataFrame(data, schema)
    if not partitions:
        return frame
    # Spark cuts local rows into as many slices as it has threads; fewer need no shuffle
    return frame.coalesce(partitions) if partitions <= spark.sparkContext.defaultParallelism else frame.repartition(partitions)


#: Kinds of values that mean the same in Arrow and to Spark's conversion from Python.
PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.DateType)


def _as_arrow(spark: SparkSession, data, schema: T.StructType | str | None) -> pa.Table | None:
    """Rows of plain values as Arrow, which Spark keeps as local rows of known size in place of a Python RDD; None for other data."""
    if schema is None or not isinstance(data, Sequence) or not all(isinstance(row, (tuple, list)) for row in data):
        return None
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    if not isinstance(schema, T.StructType) or not all(isinstance(f.dataType, PLAIN) for f in schema.fields) or any(len(row) != len(schema) for row in data):
        return None
    wanted = to_arrow_schema(schema)
    try:
        return pa.table([pa.array([row[i] for row in data], f.type) for i, f in enumerate(wanted)], schema=wanted)
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):  # Spark's conversion knows what to do, or what to say
        return None


def _from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    marked = []
    for i, field in enumerate(table.schema):
        wide = {pa.uint8(): pa.int64(), pa.uint16(): pa.int64(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}.get(field.type)
        if wide is not None:
            marked.append(field.name)
            table = table.set_column(i, pa.field(field.name, wide, field.nullable), table.column(i).cast(wide))
    frame = spark.createDataFrame(table)
    return frame.select(*(frame[f"`{c}`"].alias(c, metadata={UNSIGNED_MARK: True}) if c in marked else frame[f"`{c}`"] for c in frame.columns)) if marked else frame

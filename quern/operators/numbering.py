"""Consecutive numbers for the rows of a DataFrame, in the order of its partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.materialize import materialize


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column of the numbers 0, 1, 2, ... in the order of its partitions and of the rows in each.

    Rows are counted in each partition and written once; partition offsets
    (one number a partition) are then added.
    """
    plain = [f"c{i}" for i in range(len(df.columns))]
    schema = T.StructType([T.StructField(p, f.dataType) for p, f in zip(plain, df.schema.fields, strict=True)]).add("part", "long").add("at", "long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(np.full(rows, part)), pa.array(np.arange(n, n + rows))], schema.names)
            n += rows

    counted = materialize(df.toDF(*plain).mapInArrow(number, schema))
    offset, offsets = 0, []
    for part, rows in sorted(counted.groupBy("part").count().collect()):  # one row a partition
        offsets.append((part, offset))
        offset += rows
    out = [F.col(p).alias(c) for p, c in zip(plain, df.columns, strict=True)]
    if not offsets:
        return counted.select(*out, F.col("at").alias(name))
    added = df.sparkSession.createDataFrame(offsets, "part bigint, offset bigint")
    return counted.join(F.broadcast(added), "part").select(*out, (F.col("at") + F.col("offset")).alias(name))

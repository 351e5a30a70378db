"""How many partitions a shuffle needs, from the size of what is read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}

#: Sizes from here on are Spark's way to say that it does not know.
UNKNOWN = 1 << 60


def advisory_bytes(spark: SparkSession) -> int:
    """The size that the session wants shuffle partitions to have."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m").lower()).groups()
    return int(number) * _UNITS[unit]


def source_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that a DataFrame reads; None where Spark can't tell."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    except AttributeError:  # Spark Connect
        return None
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < UNKNOWN else None


def partitions_for(spark: SparkSession, size: int | None) -> int:
    """Partitions of the advisory size, but at least as many as the session's setting."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return least if size is None else max(least, -(-size // advisory_bytes(spark)))

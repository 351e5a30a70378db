"""Percentiles per group from mergeable sketches of bounded error.

The sketch is a hierarchy of randomized compactors: a level that is full is
sorted, every other value (odd or even by a fair coin) moves to the next level
with twice the weight, and sketches merge level by level. Spark builds it in
the JVM (KLL of doubles). A group's values meet in partial aggregation first,
so a group with a third of all rows costs one sketch a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Width of the largest compactor. The error falls about as 1 / k.
DEFAULT_K = 1024


def rank_error(k: int) -> float:
    """Bound of |estimated rank - true rank| / n that a single query keeps with 99 % probability.

    The constants are those published with the sketch for single-sided queries.
    """
    return 2.296 / k**0.9021


def day_sketches(df: DataFrame, keys: Sequence[Column], value: str, time: str, k: int = DEFAULT_K) -> DataFrame:
    """Partial results per key and day of ``time``: keys, day, sketch.

    NULL and NaN values do not count, a key and day without other values gives
    no row; infinite values count; repeated rows count as often as stored. NULL
    is a key, and a day, like any other. An empty table gives no rows.
    """
    kind = df.schema[value].dataType
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*keys, F.to_date(F.col(f"`{time}`")).alias("day"), v.alias("sketch_value")).filter(F.col("sketch_value").isNotNull())
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        rows = rows.filter(~F.isnan("sketch_value"))
    return rows.groupBy(*rows.columns[:-1]).agg(F.kll_sketch_agg_double("sketch_value", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """One sketch per key from any number of partial ones: keys, sketch."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def percentiles(sketches: DataFrame, wanted: dict[str, float], k: int = DEFAULT_K) -> DataFrame:
    """The sketches' other columns, n, a column per wanted rank, and the rank error.

    A percentile is the smallest value with at least that share of values at or
    below it. Up to ``k`` values a sketch holds them all: the error is 0 then.
    """
    others = [c for c in sketches.columns if c != "sketch"]
    n = F.kll_sketch_get_n_double("sketch")
    return sketches.select(
        *others,
        n.alias("n"),
        *(F.kll_sketch_get_quantile_double("sketch", F.lit(rank)).alias(name) for name, rank in wanted.items()),
        F.when(n <= k, 0.0).otherwise(rank_error(k)).alias("rank_error"),
    )

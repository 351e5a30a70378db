"""Joins to tables that are expected to be small, safe where they are not, and the splitting of hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.materialize import materialize

#: A table of at most so many bytes, written as JSON, is sent to every executor.
BROADCAST_BYTES = 8 << 20

#: A key with more rows than this is split over several tasks ...
TASK_ROWS = 1 << 20

#: ... unless there were more such keys than this; then the bound rises until there are not.
HOT_KEYS = 10_000


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a (written) table is small enough to be sent to every executor; its size is measured."""
    row = F.octet_length(F.to_json(F.struct(*df.columns))) + 16
    return (df.agg(F.sum(row.cast("bigint"))).first()[0] or 0) <= BROADCAST_BYTES


class HotKeys:
    """How many parts each key's rows need, measured on ``rows`` (read again, only its keys, if there are enough rows for a hot key).

    Keys are known by a hash; where two share one, both are split, which is
    harmless. Only keys of several parts are kept: at most HOT_KEYS of 12 bytes
    each, so that they can be sent to every executor.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str]) -> None:
        self.keys, self.parts = list(keys), None
        total = rows.count()
        part = max(TASK_ROWS, -(-total // HOT_KEYS))
        if total > part:
            counts = rows.select(F.xxhash64(*self.keys).alias("hot_key")).groupBy("hot_key").agg(F.count(F.lit(1)).alias("rows"))
            self.parts = materialize(counts.filter(F.col("rows") > part).select("hot_key", F.ceil(F.col("rows") / part).cast("int").alias("hot_parts")))

    def _known(self, df: DataFrame) -> tuple[DataFrame, Column]:
        if self.parts is None:
            return df.withColumns({"hot_key": F.lit(0), "hot_parts": F.lit(1)}), F.lit(1)
        known = df.withColumn("hot_key", F.xxhash64(*self.keys)).join(F.broadcast(self.parts), "hot_key", "left")
        return known, F.coalesce("hot_parts", F.lit(1))

    def split(self, df: DataFrame, by: Sequence[str], name: str = "part") -> DataFrame:
        """Rows with the number of their part, which follows from a hash of the columns ``by``."""
        known, parts = self._known(df)
        return known.withColumn(name, F.pmod(F.xxhash64(*by), parts).cast("int")).drop("hot_key", "hot_parts")

    def copy(self, df: DataFrame, name: str = "part") -> DataFrame:
        """Each row once for every part of its key."""
        known, parts = self._known(df)
        return known.withColumn(name, F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot_key", "hot_parts")


def bounded_join(rows: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "inner", written: bool = False, fits: bool | None = None) -> DataFrame:
    """Inner or left semi join of ``rows`` to ``small`` on columns of the same names.

    ``small`` is written (unless it is already) and measured (unless it is known to fit). Within the bound
    it is broadcast; beyond it, the rows of a key are counted, and those of a
    hot one are spread by a hash of ``spread_by`` over as many tasks as they
    need, each with a copy of the key's small rows. NULL keys match nothing.
    """
    small = small if written or fits else materialize(small)
    if fits or (fits is None and fits_broadcast(small)):
        return rows.join(F.broadcast(small), list(keys), how)
    hot = HotKeys(rows, keys)
    return hot.split(rows, spread_by, "join_part").join(hot.copy(small, "join_part"), [*keys, "join_part"], how).drop("join_part")

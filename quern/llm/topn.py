"""The N best rows of every group, by a secondary sort.

The sort does the work: rows sorted by (group, score descending, identifier)
pass as Arrow batches through a counter that emits the first N distinct rows
of each group and holds no group, only its position in the current one. The
pass runs twice. The first runs where rows are read, so that a group with a
third of all rows leaves N rows a task before the shuffle; the second runs
after hash partitioning by group. Without groups the second is a distributed
top-k over the N rows of each task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.arrowruns import Boundaries, flat


def _first_n(n: int, width: int):
    """Keeps the first n distinct rows of each group; columns: ``width`` of the group, score, identifier."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, rows, seen = Boundaries(), Boundaries(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [flat(c) for c in batch.columns]
            new_group = groups.starts(columns[:width]) if width else np.zeros(batch.num_rows, dtype=bool)
            new_row = rows.starts(columns[: width + 2]) | new_group
            # the number of distinct rows of the group up to each row
            count = np.cumsum(new_row)
            at = np.flatnonzero(new_group)
            before = np.full(batch.num_rows, -seen, dtype=np.int64)
            if len(at):
                of = np.cumsum(new_group) - 1
                before[of >= 0] = (count[at] - 1)[of[of >= 0]]
            place = count - before
            seen = int(place[-1])
            chosen = np.flatnonzero(new_row & (place <= n))
            if len(chosen):
                yield batch.take(pa.array(chosen))

    return keep


def top_n(df: DataFrame, group: Sequence[str], score: str, identifier: str, n: int, largest: bool = True) -> DataFrame:
    """The ``n`` rows with the highest (or lowest) score of each group.

    Columns: the group's, the score and the identifier. Among equal scores the
    smaller identifier comes first. Rows equal in all of these are one row,
    however often stored. NULL and NaN scores do not take part; a NULL
    identifier sorts before others; NULL is a group of its own. A group with
    fewer rows gives what it has; an empty table or ``n`` of 0 gives nothing.
    Other columns are not read.
    """
    kind = df.schema[score].dataType
    names = [*group, score, identifier]
    plain = [f"c{i}" for i in range(len(names))]
    rows = df.select(*(F.col(f"`{a}`").alias(b) for a, b in zip(names, plain, strict=True)))
    s, i = plain[-2:]
    rows = rows.filter(F.col(s).isNotNull() & ~F.isnan(s)) if isinstance(kind, (T.DoubleType, T.FloatType)) else rows.filter(F.col(s).isNotNull())
    keys = plain[:-2]
    order = [*keys, F.col(s).desc() if largest else F.col(s).asc(), F.col(i).asc_nulls_first()]
    keep, schema = _first_n(n, len(keys)), rows.schema
    local = rows.sortWithinPartitions(*order).mapInArrow(keep, schema)
    if keys:
        best = local.repartition(*keys).sortWithinPartitions(*order).mapInArrow(keep, schema)
    else:  # the n best of each task are distinct and few; Spark takes the best of them task by task
        best = local.distinct().orderBy(*order).limit(n)
    return best.select(*(F.col(b).alias(a) for a, b in zip(names, plain, strict=True)))

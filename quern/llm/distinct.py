"""Near-exact distinct counts over sets that can be merged.

A set of identifiers is kept as sorted 64-bit hashes in delta-coded runs (see
``runs``), cut into segments by the hash's high bits, so that a set of any
size is many runs of bounded size. Partial sets per (group, day) are merged to
any span of days, set of groups or both by the k-way union of their runs,
segment by segment, and a count is the sum of the segments' lengths. Two identifiers
count as one only where their hashes collide. With n distinct identifiers that
happens for at most n (n - 1) / 2^65 pairs in expectation (birthday bound),
which also bounds the probability that a count is not exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import runs
from quern.operators.arrowruns import Boundaries, flat

#: Rows of a table for each segment of the hash space; bounds a run's length, whatever the group.
ROWS_PER_SEGMENT = 1 << 20

#: Bytes of runs that a task decodes at a time, and rows whose identifiers it puts in runs at a time.
BATCH_BYTES, CHUNK_ROWS = 8 << 20, 1 << 18


def segment_bits(rows: int) -> int:
    """High bits of the hash that name a segment, for a table of so many rows (bounds runs up to 2^51 rows)."""
    return min(31, max(0, (max(rows, 1) - 1) // ROWS_PER_SEGMENT).bit_length())


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches, without empty ones, cut so that the runs of each (its last column) hold few bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(flat(batch.column(batch.num_columns - 1))).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def _union(width: int):
    """Unites the runs of equal keys in sorted batches; the run is the last of ``width + 1`` columns.

    The only run of a key passes as it is, coded. The last key of a batch stays open.
    """

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders, names = Boundaries(), None
        held_keys, held = None, None

        def out(keys: list[pa.Array], values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([*keys, runs.encode(values, np.cumsum(counts) - counts)], names)

        for batch in _bounded(batches):
            names = batch.schema.names
            keys, coded = [flat(c) for c in batch.columns[:width]], flat(batch.column(width))
            new = borders.starts(keys)
            if held is not None and new[0]:
                yield out(held_keys, held, np.array([len(held)]))
                held = None
            new[0] = True
            group = np.cumsum(new) - 1
            first, last = np.flatnonzero(new), group[-1]
            alone = np.bincount(group) == 1
            alone[last] = False
            if held is not None:
                alone[0] = False
            single = pa.array(first[alone])
            if len(single):
                yield pa.record_batch([*(k.take(single) for k in keys), coded.take(single)], names)
            several = np.flatnonzero(~alone[group])
            values, counts = runs.decode(coded.take(pa.array(several)))
            number = np.cumsum(np.diff(group[several], prepend=group[several[0]]) > 0)
            if held is not None:
                values, counts, number = np.concatenate([held, values]), np.concatenate([[len(held)], counts]), np.concatenate([[0], number])
            values, counts = runs.union(values, counts, number)
            firsts = [k.take(pa.array(first[~alone])) for k in keys]
            if len(counts) > 1:
                yield out([k.slice(0, len(counts) - 1) for k in firsts], values[: -counts[-1]], counts[:-1])
            held_keys, held = [k.slice(len(counts) - 1) for k in firsts], values[-counts[-1] :].copy()
        if held is not None:
            yield out(held_keys, held, np.array([len(held)]))

    return unite


def _gathered(batches: Iterator[pa.RecordBatch], full: Callable[[pa.RecordBatch], int], limit: int) -> Iterator[list[pa.Array]]:
    """The columns of successive batches together, as long as what ``full`` measures of them stays near ``limit``."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += full(batch)
        if size >= limit:
            yield [flat(c) for c in pa.Table.from_batches(held).columns]
            held, size = [], 0
    if held:
        yield [flat(c) for c in pa.Table.from_batches(held).columns]


def _codes(keys: Sequence[pa.Array]) -> np.ndarray:
    """Equal numbers for equal keys, NULL being equal to NULL."""
    code, known = np.zeros(len(keys[0]), dtype=np.int64), 1
    for key in keys:
        distinct = flat(pc.dictionary_encode(key, null_encoding="encode"))
        if known * len(distinct.dictionary) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            known = int(code.max()) + 1
        code = code * len(distinct.dictionary) + distinct.indices.to_numpy()
        known *= len(distinct.dictionary)
    return code


def _unite_chunks(width: int):
    """Unites the runs of equal keys among the rows that come together, in any order; the rest is left to ``_union``."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []

        def named() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names[:] = batch.schema.names
                yield batch

        for columns in _gathered(_bounded(named()), lambda b: b.column(width).nbytes, BATCH_BYTES):
            code = _codes(columns[:width])
            order = np.argsort(code, kind="stable")
            code = code[order]
            new = np.diff(code, prepend=-1) > 0
            values, counts = runs.decode(columns[width].take(pa.array(order)))
            values, counts = runs.union(values, counts, np.cumsum(new) - 1)
            first = pa.array(order[new])
            yield pa.record_batch([*(c.take(first) for c in columns[:width]), runs.encode(values, np.cumsum(counts) - counts)], names)

    return unite


def merge_runs(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of the runs of equal (keys, segment): keys, segment, run.

    ``sets`` has the keys, ``segment`` and ``run``. Runs that are read together
    are united before the shuffle by key and segment, all of a key after it.
    """
    by = [*keys, "segment"]
    rows = sets.select(*by, "run")
    local = rows.mapInArrow(_unite_chunks(len(by)), rows.schema)
    return local.repartition(*by).sortWithinPartitions(*by).mapInArrow(_union(len(by)), rows.schema)


def partial_sets(df: DataFrame, keys: Sequence[Column], identifier: str, bits: int) -> DataFrame:
    """One run of identifiers per key and segment; the partial results to be stored and combined.

    Columns: the keys (named by their aliases), segment, run. NULL identifiers
    do not count; NULL is a key like any other; repeated rows change nothing.
    """
    hashed = df.select(*keys, F.xxhash64(F.col(f"`{identifier}`")).alias("h"), F.col(f"`{identifier}`").isNotNull().alias("counts")).filter("counts").drop("counts")
    names = hashed.columns[:-1]
    segment = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    rows = hashed.withColumn("segment", segment).select(*names, "segment", "h")
    width = len(names) + 1
    schema = reduce(lambda s, f: s.add(f), rows.schema.fields[:-1], type(rows.schema)()).add("run", "binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run for each key and segment of a chunk of rows; keys of several chunks get several."""
        for columns in _gathered(batches, len, CHUNK_ROWS):
            group, values = _codes(columns[:width]), columns[width].to_numpy().view(np.uint64)
            order = np.lexsort((values, group))
            values, group = values[order], group[order]
            fresh = np.ones(len(values), dtype=bool)
            fresh[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
            values, group, order = values[fresh], group[fresh], order[fresh]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            first = pa.array(order[starts])
            yield pa.record_batch([*(c.take(first) for c in columns[:width]), runs.encode(values, starts)], schema.names)

    by = [*names, "segment"]
    local = rows.mapInArrow(build, schema)
    unite = _union(width)
    return local.repartition(*by).sortWithinPartitions(*by).mapInArrow(unite, schema)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _bounded(batches):
        yield pa.record_batch([*batch.columns[:-1], pa.array(runs.decode(flat(batch.column(batch.num_columns - 1)))[1])], [*batch.schema.names[:-1], "n"])


def count_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct identifiers per key, and the bound of the error: keys, n_distinct, collision_bound.

    ``sets`` has at most one run for each key and segment, as merge_runs and
    partial_sets give them.
    """
    rows = sets.select(*keys, "run")
    schema = reduce(lambda s, f: s.add(f), rows.schema.fields[:-1], type(rows.schema)()).add("n", "long")
    counted = rows.mapInArrow(_lengths, schema).groupBy(*keys).agg(F.sum("n").alias("n_distinct"))
    n = F.col("n_distinct").cast("double")
    return counted.withColumn("collision_bound", n * (n - 1) / F.lit(2.0**65))

"""Per-key counts and sums when a few keys hold most rows.

Rows are first combined where they are read: an Arrow pass turns each chunk of
rows into one partial state per key, so a key with a third of all rows shrinks
to one state per chunk before anything is shuffled. The states are range
partitioned on (grouping, key, order) by quantiles of a sample of the rows, the
key standing there as its 64-bit hash, so that bounds are of one small size
however long keys are. The order, a number that tells chunks apart, lets a heavy
key spread over several partitions, and no partition is much larger than
another. Each partition is merged on its own. Only keys on a bound between two
partitions can have states in both; those edge states are stitched by a last
small aggregation.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.arrowruns import flat
from quern.operators.materialize import materialize
from quern.operators.sizing import partitions_for, source_bytes

#: Rows that one task combines at a time; bounds the memory of the first pass.
CHUNK_ROWS = 1 << 18

#: States expected of the sample for each partition, and at most in all (of 32 bytes each, at the driver).
SAMPLE_STATES, MOST_SAMPLE_STATES = 100, 1 << 20

STATE = "range int, edge boolean, grouping bigint, key string, n bigint, n_values bigint, total double"
SAMPLE = "grouping bigint, mark bigint, n bigint, task bigint"

#: A composite key is written as text: a part per column, each NULL or VALUE
#: mark first, parts joined by SEP; ESC keeps values that hold SEP apart.
SEP, ESC, NULL, VALUE = "\x1f", "\x1b", "~", "="


@dataclass
class Input:
    """A table, the column to be summed (if any), and its groupings: label -> key columns."""

    df: DataFrame
    value: str | None
    groupings: dict[int, list[str]] = field(default_factory=dict)


def _escaped(values: pa.Array) -> pa.Array:
    if pc.any(pc.match_substring_regex(values, f"[{SEP}{ESC}]")).as_py():
        values = pc.replace_substring(values, ESC, ESC + "1")
        values = pc.replace_substring(values, SEP, ESC + "2")
    return values


def _encoded(columns: Sequence[pa.Array], rows: int) -> pa.Array:
    if not columns:
        return pa.array([""] * rows, pa.string())
    parts = []
    for column in columns:
        text = _escaped(pc.fill_null(pc.cast(column, pa.string()), ""))
        marked = pc.binary_join_element_wise(VALUE, text, "")
        parts.append(pc.if_else(pc.is_null(column), NULL, marked) if column.null_count else marked)
    return pc.binary_join_element_wise(*parts, SEP)


def _unescaped(part: Column) -> Column:
    text = F.replace(F.substring(part, 2, 1 << 30), F.lit(ESC + "2"), F.lit(SEP))
    return F.replace(text, F.lit(ESC + "1"), F.lit(ESC))


def decoded(key: Column, width: int) -> list[Column]:
    """The parts of an encoded key as text, NULL where the value was NULL."""
    parts = F.split(key, SEP, -1)
    return [F.when(parts[i] != NULL, _unescaped(parts[i])) for i in range(width)]


def key_text(key: Column) -> Column:
    """An encoded key as plain text: values joined by ``|``, NULL written as ``null``."""
    plain = F.transform(F.split(key, SEP, -1), lambda part: F.when(part == NULL, F.lit("null")).otherwise(_unescaped(part)))
    return F.when(key == "", F.lit("")).otherwise(F.array_join(plain, "|"))


def key_marks(keys: pa.Array) -> np.ndarray:
    """What stands for encoded keys in the order of ranges."""
    return pd.util.hash_array(keys.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)


def chunk_order(partition: int, chunk: int) -> int:
    """The order of a chunk, 32 bits; any run of chunks is spread evenly over them (multiples of irrational numbers)."""
    return (partition * 0x9E3779B1 + chunk * 0x6A09E667) & 0xFFFFFFFF


@dataclass
class Bounds:
    """Lower bounds of the ranges after the first, in the order of (grouping, mark, order)."""

    grouping: np.ndarray
    mark: np.ndarray
    order: np.ndarray

    def place(self, grouping: int, marks: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The range of each state of a chunk, and whether its key has states in other ranges, too, or may have them."""
        first, end = np.searchsorted(self.grouping, [grouping, grouping + 1])
        own = self.mark[first:end]
        low, high = np.searchsorted(own, marks, "left"), np.searchsorted(own, marks, "right")
        edge = high > low
        for i in np.flatnonzero(edge):
            low[i] += np.searchsorted(self.order[first + low[i] : first + high[i]], order, "right")
        return (first + low).astype(np.int32), edge


def _combined(batches: list[pa.RecordBatch], groupings: dict[int, list[int]], valued: bool) -> Iterator[tuple[int, pa.Table, pa.Array]]:
    """One state per key of some rows, for each grouping: label, table with count_all, v_count and v_sum, encoded keys."""
    table = pa.Table.from_batches(batches)
    columns = [flat(c) for c in table.columns]
    value = columns[-1] if valued else pa.nulls(table.num_rows, pa.float64())
    for label, positions in groupings.items():
        names = [f"k{i}" for i in range(len(positions))]
        grouped = pa.table([*(columns[p] for p in positions), value], [*names, "v"]).group_by(names, use_threads=False)
        found = grouped.aggregate([([], "count_all"), ("v", "count"), ("v", "sum")])
        yield label, found, _encoded([flat(found[name]) for name in names], found.num_rows)


def _sampler(groupings: dict[int, list[int]], valued: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for label, found, keys in _combined([batch], groupings, valued):
                    task = np.full(len(keys), TaskContext.get().partitionId())
                    yield pa.record_batch([pa.array(np.full(len(keys), label)), pa.array(key_marks(keys)), flat(found["count_all"]).cast(pa.int64()), pa.array(task)], ["grouping", "mark", "n", "task"])

    return sample


def _combiner(groupings: dict[int, list[int]], valued: bool, bounds: Bounds) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """groupings: label -> positions of the key columns; the value, if any, is the last column."""

    def states(batches: list[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
        for label, found, keys in _combined(batches, groupings, valued):
            place, edge = bounds.place(label, key_marks(keys), order)
            counts = [flat(found[c]).cast(pa.int64()) for c in ("count_all", "v_count")]
            total = pc.fill_null(flat(found["v_sum"]).cast(pa.float64()), 0.0)
            yield pa.record_batch([pa.array(place), pa.array(edge), pa.array(np.full(len(keys), label)), keys, *counts, total], ["range", "edge", "grouping", "key", "n", "n_values", "total"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, chunk, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield from states(held, chunk_order(partition, chunk))
                chunk, held, rows = chunk + 1, [], 0
        if held:
            yield from states(held, chunk_order(partition, chunk))

    return combine


def sampled_bounds(sample: pd.DataFrame, share: float, chunks: dict[int, int], partitions: int) -> Bounds:
    """Quantiles of the states that rows will combine to, from a ``share`` of the rows: grouping, mark, n, task.

    A key seen n times has about n / share rows, and so many states, but no
    more than chunks that have it; a key seen once stands for those not seen.
    There are at least ``chunks`` of a grouping, and one for each task.
    Quantiles within a key are cut by the order of its chunks.
    """
    tasks = sample.groupby("grouping")["task"].nunique()
    chunks = {label: max(n, tasks.get(label, 0)) for label, n in chunks.items()}
    keys = sample.groupby(["grouping", "mark"], sort=True)["n"].sum().reset_index()
    rows, among = keys["n"].to_numpy() / share, keys["grouping"].map(chunks).to_numpy(dtype=float)
    states = np.where((keys["n"] == 1) & (share < 1), rows, np.minimum(rows, among * -np.expm1(-rows / among)))
    ends = np.cumsum(states)
    wanted = np.arange(1, partitions) * (ends[-1] / partitions) if len(ends) else np.empty(0)
    at = np.minimum(np.searchsorted(ends, wanted), max(len(ends) - 1, 0))
    within = (wanted - (ends[at] - states[at])) / states[at] if len(ends) else wanted
    order = (np.clip(within, 0, 1) * 2**32).astype(np.int64)
    return Bounds(keys["grouping"].to_numpy()[at], keys["mark"].to_numpy()[at], order)


def _plain(df: DataFrame, name: str, alias: str) -> Column:
    """A key column as Arrow groups it; other types than integers, strings, booleans and dates go as text."""
    kind = df.schema[name].dataType
    column = df[f"`{name}`"]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        column = (column + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)):
        column = F.base64(column) if isinstance(kind, T.BinaryType) else F.to_json(column)
    elif not isinstance(kind, (T.IntegralType, T.StringType, T.BooleanType)):
        column = column.cast("string")
    return column.alias(alias)


def balanced_states(inputs: Sequence[Input], partitions: int | None = None) -> DataFrame:
    """Complete count, count of values and sum per (grouping, key).

    Columns: grouping, key (encoded, see ``key_text`` and ``decoded``), n,
    n_values, total (NULL where the key has no value; NaN where it has a NaN).
    The merged states are written to the shared folder once, since they are
    read twice: keys inside a partition are complete, edges are stitched.
    Without ``partitions`` their number follows from the inputs' sizes, each
    counted for every grouping, so that a task's share does not grow with them.
    """
    if not inputs:
        raise ValueError("balanced_states needs an input")
    numbers = reduce(DataFrame.unionByName, (x.df.select(F.lit(i).alias("input")) for i, x in enumerate(inputs)))
    counts = dict(numbers.groupBy("input").count().collect())  # a row for each input
    selected, size, weight, chunks = [], 0, 0, {}
    for i, x in enumerate(inputs):
        own, rows = source_bytes(x.df), counts.get(i, 0)
        size = None if own is None or size is None else size + own * len(x.groupings)
        weight += rows * len(x.groupings)
        used = list(dict.fromkeys(c for keys in x.groupings.values() for c in keys))
        positions = {label: [used.index(c) for c in keys] for label, keys in x.groupings.items()}
        columns = [_plain(x.df, c, f"k{i}") for i, c in enumerate(used)]
        if x.value is not None:
            columns.append(x.df[f"`{x.value}`"].cast("double").alias("v"))
        df = x.df.select(*(columns or [F.lit(1).alias("k0")]))
        selected.append((df, positions, x.value is not None))
        chunks |= dict.fromkeys(positions, max(1, rows // CHUNK_ROWS))
    partitions = partitions or partitions_for(inputs[0].df.sparkSession, size)
    share = min(1.0, min(MOST_SAMPLE_STATES, SAMPLE_STATES * partitions) / max(weight, 1))
    sample = reduce(DataFrame.unionByName, (df.sample(share, seed=0).mapInArrow(_sampler(positions, valued), SAMPLE) for df, positions, valued in selected))
    bounds = sampled_bounds(sample.toArrow().to_pandas(), share, chunks, partitions)
    states = reduce(DataFrame.unionByName, (df.mapInArrow(_combiner(positions, valued, bounds), STATE) for df, positions, valued in selected))
    # grouping by the range, too, lets each partition be merged where it is
    merged = states.repartitionById(partitions, F.col("range")).groupBy("range", "edge", "grouping", "key").agg(F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"))
    merged = materialize(merged.drop("range"))
    inner = merged.filter(~F.col("edge")).drop("edge")
    stitched = merged.filter("edge").groupBy("grouping", "key").agg(F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"))
    return inner.unionByName(stitched).withColumn("total", F.when(F.col("n_values") > 0, F.col("total")))


def balanced_group_by(df: DataFrame, keys: Sequence[str], value: str | None = None, partitions: int | None = None) -> DataFrame:
    """Rows (``n``) and, with ``value``, its sum (``total``) per key, however uneven the keys are.

    NULL is a key like any other; NULL values do not count in the sum, a NaN
    makes it NaN; repeated rows count as often as they are stored; an empty
    table gives no rows. Key columns keep their names and types (float keys:
    -0.0 is 0.0). Other columns of ``df``, whatever their names, are not read.
    """
    found = balanced_states([Input(df, value, {0: list(keys)})], partitions)
    out = []
    for name, part in zip(keys, decoded(F.col("key"), len(keys)), strict=True):
        kind = df.schema[name].dataType
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            part = F.from_json(part, kind)
        elif isinstance(kind, T.BinaryType):
            part = F.unbase64(part)
        else:
            part = part.cast(kind)
        out.append(part.alias(name))
    extra = [F.col("n"), F.col("total")] if value is not None else [F.col("n")]
    return found.select(*out, *extra)


def exchange_counts(spark: SparkSession, exchanges: DataFrame, table: Callable[[str], DataFrame | None]) -> DataFrame:
    """Rows per key of every exchange, and the sum of ``amount`` where its table has one.

    ``exchanges`` has a row per planned exchange (exchange_id, input_table,
    key_columns as positions); it is plan metadata, of the size of a query
    plan, and read to the driver. Every input table is scanned once for all of
    its exchanges. An exchange without an id or key columns (NULL), of an
    unknown table or with a position that the table lacks has no keys, and a
    warning names it; an empty list of key columns puts all rows under one key.
    Columns: exchange_id, key, n, total.
    """
    plans: dict[str, dict[int, list[str]]] = {}
    frames: dict[str, DataFrame | None] = {}
    for row in exchanges.select("exchange_id", "input_table", "key_columns").distinct().collect():
        name = row["input_table"]
        if name not in frames:
            frames[name] = table(name) if name is not None else None
        df, positions = frames[name], row["key_columns"]
        if df is None or positions is None or row["exchange_id"] is None or any(p is None or not 0 <= p < len(df.columns) for p in positions):
            warnings.warn(f"exchange {row['exchange_id']} on columns {positions} of table {name} can't be worked out and has no keys", stacklevel=2)
            continue
        plans.setdefault(name, {})[row["exchange_id"]] = [df.columns[p] for p in positions]
    inputs = [Input(frames[name], "amount" if "amount" in frames[name].columns else None, g) for name, g in plans.items()]
    if not inputs:
        return spark.createDataFrame([], "exchange_id bigint, key string, n bigint, total double")
    return balanced_states(inputs).select(F.col("grouping").alias("exchange_id"), "key", "n", "total")


def heavy_keys(counts: DataFrame, share: int = 50) -> DataFrame:
    """Keys with at least one ``share``-th of their exchange's rows, over all rows of it.

    The totals are broadcast: they have one row for each planned exchange, and
    a shuffle on so few keys would put all counts into a few tasks.
    """
    totals = counts.groupBy("exchange_id").agg(F.sum("n").alias("rows"))
    return counts.join(F.broadcast(totals), "exchange_id").filter(F.col("n") * share >= F.col("rows")).select("exchange_id", key_text(F.col("key")).alias("key_text"), "n", "total")

"""References to records that do not exist, found by bitmaps of keys.

1. Keys of references and parents get dense integer codes (a dictionary), in
   key order, so that a key range is a range of codes.
2. Per key range and period (month) two kinds of compressed bitmaps are built:
   keys that are referred to, per table; and keys with a parent row that
   exists during the whole period.
3. reference AND-NOT parent leaves the keys whose references of that period
   may be orphans; the surviving bits are decoded to keys.
4. Only records of surviving (key, period) pairs are held against the parents'
   exact times, hour by hour; that settles keys that begin or end within the
   period.

What is shuffled is one row per distinct (table, period, key) and the records
of survivors, never all records; a key with a third of all rows is one bit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import bitmaps
from quern.operators.arrowruns import Boundaries, flat
from quern.operators.bounded import HotKeys, bounded_join, fits_broadcast
from quern.operators.materialize import materialize
from quern.operators.numbering import numbered

#: Periods that are worked on at a time where a key range is built; bounds the memory of a task.
PERIOD_BLOCK = 64

#: References without a time are placed here; no parent covers it.
NO_PERIOD = -(1 << 30)


@dataclass
class References:
    """A table with references: its label, the record's id, the key referred to, the record's time."""

    name: str
    df: DataFrame
    record: str
    key: str
    time: str


def dense_codes(keys: DataFrame, key: str = "key") -> DataFrame:
    """Codes 0, 1, 2, ... for the distinct values of a column, in its order: (key, code).

    Values are range partitioned, sorted and numbered. NULL gets no code.
    """
    distinct = keys.select(F.col(f"`{key}`").alias("key")).filter("key IS NOT NULL").distinct()
    return numbered(distinct.repartitionByRange("key").sortWithinPartitions("key"), "code")


def reference_bitmaps(coded: DataFrame) -> DataFrame:
    """(source, period, code) -> a container per source (table), period (month) and key range: (source, period, range, bits)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders, held, low = Boundaries(), None, []

        def out() -> pa.RecordBatch:
            return pa.record_batch([*held, pa.array([bitmaps.pack(np.concatenate(low))], pa.binary())], ["source", "period", "range", "bits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [flat(batch.column(c)) for c in ("source", "period", "range")]
            code, starts = flat(batch.column("low")).to_numpy(), borders.starts(keys)
            at = np.flatnonzero(starts)
            if len(at) == 0 or at[0] > 0:
                low.append(code[: at[0] if len(at) else len(code)])
            for i, a in enumerate(at):
                if held is not None:
                    yield out()
                held, low = [k.slice(a, 1) for k in keys], [code[a : at[i + 1] if i + 1 < len(at) else len(code)]]
        if held is not None:
            yield out()

    order = ["source", "period", "range"]
    placed = coded.select("source", "period", F.shiftright("code", 16).alias("range"), F.col("code").bitwiseAND(bitmaps.BITS - 1).cast("int").alias("low"))
    return placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(build, "source int, period int, range bigint, bits binary")


def parent_bitmaps(coded: DataFrame, periods: Sequence[int]) -> DataFrame:
    """(code, since, until) -> a container per period and key range of the keys that exist all through the period.

    ``since``, ``until`` and ``periods`` number months. A parent row is tested
    against a block of periods at once where its range is built, so rows are
    multiplied by the number of blocks only.
    """
    blocks = [list(periods[i : i + PERIOD_BLOCK]) for i in range(0, len(periods), PERIOD_BLOCK)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders, held, bits = Boundaries(), None, None

        def out() -> pa.RecordBatch:
            block, high = held
            full = [i for i in range(len(blocks[block])) if bits[i].any()]
            names = pa.array([blocks[block][i] for i in full], pa.int32())
            return pa.record_batch([names, pa.array([high] * len(full), pa.int64()), pa.array([bitmaps.pack_bits(bits[i]) for i in full], pa.binary())], ["period", "range", "bits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [flat(batch.column(c)) for c in ("block", "range")]
            starts = borders.starts(keys)
            low, since, until = (flat(batch.column(c)).to_numpy() for c in ("low", "since", "until"))
            cuts = [0, *(a for a in np.flatnonzero(starts) if a), len(low)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if starts[a]:
                    if held is not None:
                        yield out()
                    held = tuple(k[int(a)].as_py() for k in keys)
                    bits = np.zeros((len(blocks[held[0]]), bitmaps.BITS), dtype=bool)
                for i, month in enumerate(blocks[held[0]]):
                    bits[i, low[a:b][(since[a:b] <= month) & (until[a:b] > month)]] = True
        if held is not None:
            yield out()

    placed = coded.select(
        F.explode(F.sequence(F.lit(0), F.lit(max(1, len(blocks)) - 1))).alias("block"),
        F.shiftright("code", 16).alias("range"),
        F.col("code").bitwiseAND(bitmaps.BITS - 1).cast("int").alias("low"),
        "since",
        "until",
    )
    if not blocks:
        placed = placed.limit(0)
    return placed.repartition("block", "range").sortWithinPartitions("block", "range").mapInArrow(build, "period int, range bigint, bits binary")


def surviving_codes(references: DataFrame, parents: DataFrame) -> DataFrame:
    """reference AND-NOT parent per key range and period, decoded: (source, period, code)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, period, high, left, right in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                left_over = bitmaps.and_not(left, right)
                if len(left_over):
                    yield pa.record_batch([pa.array([source] * len(left_over), pa.int32()), pa.array([period] * len(left_over), pa.int32()), pa.array(left_over + (high << 16))], ["source", "period", "code"])

    pairs = references.join(parents.withColumnRenamed("bits", "parent_bits"), ["period", "range"], "left")
    return pairs.select("source", "period", "range", "bits", "parent_bits").mapInArrow(decode, "source int, period int, code bigint")


def _month(at: Column) -> Column:
    """Months since year 0."""
    return (F.year(at) * 12 + F.month(at) - 1).cast("bigint")


def _whole_months(spans: DataFrame) -> DataFrame:
    """Spans cut to the whole months they cover, each once: key, since (first month), until (first month no longer covered).

    A key has few of them, however many parent rows it has.
    """
    begins = F.make_timestamp_ntz(F.year("since"), F.month("since"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) == F.col("since").cast("timestamp_ntz")
    first = _month(F.col("since")) + F.when(begins, 0).otherwise(1)
    end = F.coalesce(_month(F.col("until")), F.lit(1 << 40))
    return spans.select("key", first.alias("since"), end.alias("until")).filter("since < until").distinct()


def find_orphans(references: Sequence[References], parents: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """Records whose reference finds no parent row existing at the record's time.

    Columns: table_name, year_month, record_id; one row per record, even where
    it is stored twice. A parent row exists from ``since`` until before
    ``until`` (NULL: for ever); rows without a key or ``since`` match nothing.
    A NULL reference is none. A record without a time finds no parent and is
    reported with a NULL month. Empty tables: without parents every reference
    is an orphan, without references nothing is reported. Key types must be
    the same on both sides. Only the named columns are read, so others may
    have any names.
    """
    records = None
    for i, r in enumerate(references):
        if r.df.schema[r.key].dataType != parents.schema[key].dataType:
            raise TypeError(f"{r.name}.{r.key} and the parents' {key} differ in type")
        at = F.col(f"`{r.time}`")
        part = r.df.select(
            F.lit(i).alias("source"), F.col(f"`{r.record}`").alias("record"), F.col(f"`{r.key}`").alias("key"), at.alias("time"), F.coalesce(_month(at).cast("int"), F.lit(NO_PERIOD)).alias("period")
        ).filter("key IS NOT NULL")
        records = part if records is None else records.unionByName(part)
    spans = parents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{since}`").alias("since"), F.col(f"`{until}`").alias("until")).filter("key IS NOT NULL AND since IS NOT NULL").distinct()

    referred = materialize(records.select("source", "period", "key").distinct())
    codes = dense_codes(referred.select("key").unionByName(spans.select("key")))
    periods = sorted(p for (p,) in referred.select("period").distinct().collect() if p != NO_PERIOD)  # one a month
    referring = reference_bitmaps(referred.join(codes, "key"))
    existing = _whole_months(spans).join(codes, "key").select("code", "since", "until")
    left_over = materialize(surviving_codes(referring, parent_bitmaps(existing, periods)).join(codes, "code").select("source", "period", "key"))

    # within the bound, records are filtered by the survivors where they are read
    fits = fits_broadcast(left_over)
    suspects = bounded_join(records, left_over, ["source", "period", "key"], ["record", "time"], "left_semi", written=True, fits=fits)
    suspects = materialize(suspects.select("source", "record", "key", "time").distinct())
    near = bounded_join(spans, left_over.select("key").distinct(), ["key"], ["since", "until"], "left_semi", fits=fits or None)
    orphans = _without_parent(suspects, near)
    names = F.element_at(F.array(*(F.lit(r.name) for r in references)), F.col("source") + 1)
    return orphans.select(names.alias("table_name"), F.date_format("time", "yyyy-MM").alias("year_month"), F.col("record").alias("record_id")).distinct()


def _without_parent(records: DataFrame, spans: DataFrame) -> DataFrame:
    """Records (key, time and others) without a span of their key that covers their time, exactly.

    In order of time, a record has a parent if a span that began by then lasts
    longer. What spans of earlier hours leave, the latest end among them, is
    summed up in one row for each hour of a key; so only the spans and the
    records of one hour meet, and the records of a hot hour are split.
    """
    hour = lambda at: (F.datediff(F.to_date(at), F.lit("1970-01-01")) * 24 + F.hour(at)).alias("hour")
    parents = spans.select("key", hour(F.col("since")), F.col("since").alias("time"), "until", F.col("until").isNull().alias("forever"))
    children = records.withColumn("hour", hour(F.col("time")))
    begun = parents.groupBy("key", "hour").agg(F.max("until").alias("until"), F.max("forever").alias("forever")).withColumn("asked", F.lit(False))
    asked = children.select("key", "hour").distinct().withColumn("asked", F.lit(True))
    earlier = Window.partitionBy("key").orderBy(F.asc_nulls_first("hour"), F.desc("asked")).rowsBetween(Window.unboundedPreceding, -1)
    left = begun.unionByName(asked, allowMissingColumns=True).withColumns({c: F.max(c).over(earlier) for c in ("until", "forever")}).filter("asked")

    hot = HotKeys(children, ["key", "hour"])
    known = left.select("key", "hour", "until", "forever", F.lit(0).alias("rank")).unionByName(parents.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    both = hot.copy(known).unionByName(hot.split(children, ["record", "time"]).withColumn("rank", F.lit(2)), allowMissingColumns=True)
    # what earlier hours leave has no time and comes first; a span that begins at a record's time comes before it
    so_far = Window.partitionBy("key", "hour", "part").orderBy(F.asc_nulls_first("time"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumns({"lasts": F.max("until").over(so_far), "ever": F.coalesce(F.max("forever").over(so_far), F.lit(False))})
    return held.filter((F.col("rank") == 2) & ~F.col("ever") & ~F.coalesce(F.col("lasts") > F.col("time"), F.lit(False)))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table and month: (table_name, year_month, orphans)."""
    return orphans.groupBy("table_name", "year_month").agg(F.count(F.lit(1)).alias("orphans"))

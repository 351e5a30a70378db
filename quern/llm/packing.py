"""Filling containers of fixed capacity with whole texts: minimum bin slack.

Texts are dealt to windows of bounded size by a hash, each window is packed on
its own, and a window wastes no more than its last few containers. In a window
only the multiset of lengths matters. A container begins with the longest
text left; then a subset-sum dynamic program over bitsets (bit s set: length s
can be reached) looks for the multiset of other lengths that fills the rest
most closely, and the counts of each length are read back from the stages. The
pattern found is used as often as the lengths left allow, and texts are then
handed out to the patterns.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces to be packed together in one task.
WINDOW_PIECES = 1 << 14

PACKED = "container_kind string, capacity_tokens int, container_id bigint, id {id}, piece int, first_token bigint, n_tokens bigint"


def best_fill(lengths: list[int], counts: dict[int, int], room: int, over: int = 0) -> dict[int, int]:
    """The multiset of the lengths at hand whose sum comes closest to ``room`` and exceeds it by ``over`` at most.

    ``lengths`` is sorted. They are taken from the longest that fits, and the
    search ends as soon as ``room`` can be filled exactly; short ones are kept
    for later containers. Of two sums as close the smaller one is taken.
    """
    top = room + over
    reach, full = 1, (1 << (top + 1)) - 1
    stages: list[tuple[int, int, int]] = []
    for i in range(bisect_right(lengths, top) - 1, -1, -1):
        length = lengths[i]
        most = min(counts[length], top // length)
        stages.append((length, most, reach))
        step = 1
        while most > 0:  # 1, 2, 4, ... copies and the rest: every count up to the most
            take = min(step, most)
            reach |= (reach << (length * take)) & full
            most, step = most - take, step * 2
        if reach >> room & 1:
            break
    total, chosen = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1, {}
    beyond = reach >> (room + 1)
    if beyond and (above := (beyond & -beyond).bit_length()) < room - total:
        total = room + above
    for length, most, before in reversed(stages):
        copies = next(k for k in range(most + 1) if total >= k * length and before >> (total - k * length) & 1)
        if copies:
            chosen[length] = copies
            total -= copies * length
    return chosen


def patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fills of containers and how often each is used, until no length is left."""
    left, lengths = dict(counts), sorted(counts)

    def take(length: int, copies: int) -> None:
        left[length] -= copies
        if not left[length]:
            del left[length], lengths[bisect_left(lengths, length)]

    while left:
        longest = lengths[-1]
        first = left[longest]
        take(longest, 1)
        fill = best_fill(lengths, left, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times = min((first if n == longest else left[n]) // k for n, k in fill.items())
        yield fill, times
        for n, k in fill.items():
            copies = k * times - (n == longest)
            if copies:
                take(n, copies)


def _pack_window(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["n_tokens", "id", "piece"], kind="stable").reset_index(drop=True)
    capacity, window = int(rows["capacity_tokens"].iloc[0]), int(rows["window"].iloc[0])
    at = {int(n): list(index)[::-1] for n, index in rows.groupby("n_tokens").indices.items()}
    number, container = 0, [0] * len(rows)
    for fill, times in patterns({n: len(x) for n, x in at.items()}, capacity):
        for _ in range(times):
            for length, copies in fill.items():
                for _ in range(copies):
                    container[at[length].pop()] = number
            number += 1
    rows["container_id"] = pd.Series(container, dtype="int64") + (window << 32)
    return rows


def pack(sizes: DataFrame, containers: DataFrame, window_pieces: int = WINDOW_PIECES) -> DataFrame:
    """Assign texts to containers, for each kind of container.

    ``sizes`` has id and n_tokens, ``containers`` container_kind and
    capacity_tokens. A text within the capacity stays whole; a longer one is
    cut into pieces of the capacity and a rest. Columns: container_kind,
    capacity_tokens, container_id (unique within the kind), id, piece (from 0),
    first_token, n_tokens.

    Texts without tokens or with a NULL size are left out, and so are kinds
    without a positive capacity. A repeated row is another text. The number of
    windows follows from the number of pieces, which is counted first.
    """
    kinds = containers.filter("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()  # a handful of settings
    texts = sizes.filter("n_tokens > 0").select("id", F.col("n_tokens").cast("bigint").alias("total"))
    out = None
    key = texts.schema["id"].dataType.simpleString()
    for kind, capacity in kinds:
        cut = texts.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.floor((F.col("total") - 1) / capacity)).cast("int"))))
        cut = cut.withColumn("first_token", F.col("piece").cast("bigint") * capacity)
        pieces = cut.select(F.lit(kind).alias("container_kind"), F.lit(capacity).cast("int").alias("capacity_tokens"), "id", "piece", "first_token", F.least(F.col("total") - F.col("first_token"), F.lit(capacity)).cast("bigint").alias("n_tokens"))
        windows = max(1, -(-pieces.count() // window_pieces))
        placed = pieces.withColumn("window", F.pmod(F.xxhash64("id", "piece", "n_tokens"), F.lit(windows)).cast("bigint"))
        out = placed if out is None else out.unionByName(placed)
    if out is None:
        return sizes.sparkSession.createDataFrame([], PACKED.format(id=key))
    schema = PACKED.format(id=key)
    names = [part.split()[0] for part in schema.split(", ")]
    return out.groupBy("container_kind", "window").applyInPandas(lambda rows: _pack_window(rows)[names], schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, their tokens, the least number that could do, and the share of space used."""
    per_kind = packed.groupBy("container_kind", "capacity_tokens").agg(
        F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces")
    )
    space = F.col("containers") * F.col("capacity_tokens")
    return per_kind.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("bigint")).withColumn("fill", F.col("tokens") / space)

"""Mixing sources to target weights, in whole texts.

Every text gets a hash-random key. A source is range-sorted by it: equal
ranges of uniform keys are even partitions, as many as the source's texts
need, so that a source with a third of all texts is many partitions. Token
sums of the partitions, prefix-summed per source, and running sums inside each
partition give each text its exact place in its source's random order. A
source's budget of tokens is then a number of full rounds (epochs) over the
source and a cut in one more round.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.packing import best_fill
from quern.operators.bounded import bounded_join

#: Texts to be sorted together in one task.
RANGE_TEXTS = 1 << 16

#: Tokens on either side of a source's cut among whose texts the closest sum is looked for; bounds the work of a task.
AROUND_TOKENS = 1 << 16


def positions(texts: DataFrame, seed: int = 0, range_texts: int = RANGE_TEXTS) -> DataFrame:
    """The place of each text in the random order of its source.

    ``texts`` has id, source, n_tokens. Columns: id, source, n_tokens,
    begins (tokens of the source before the text). The order depends on seed
    and ids only.
    """
    n = texts.groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    ranges = n.select("source", F.ceil(F.col("texts") / range_texts).cast("bigint").alias("ranges"))
    # the top 31 bits of the key scaled to the number of ranges: an order-preserving range number
    keyed = texts.withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 1))
    placed = bounded_join(keyed, ranges, ["source"], ["id"]).withColumn("range", F.shiftright(F.shiftright("key", 32) * F.col("ranges"), 31))
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"))
    before = sums.select("source", "range", F.coalesce(F.sum("tokens").over(across), F.lit(0)).alias("before"))
    run = placed.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return run.join(before, ["source", "range"]).select("id", "source", "n_tokens", (F.col("before") + F.col("within")).alias("begins"))


def budgets(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """What each source of each mix is to give.

    ``targets`` has mix_name, source, weight, max_repeats; weights are relative
    within a mix, and count as 0 where NULL, NaN, infinite or negative; a NULL
    max_repeats sets no cap. A source named twice in a mix counts once, with
    the sum of its weights and its lowest cap. A NULL source is none: targets
    can't name it, and its texts take no part.

    Without ``total_tokens`` a mix has as many tokens as its sources with a
    weight hold together, or fewer if a source's capped texts could not give
    its share of that many: then the most at which all sources that have texts
    reach their share. With ``total_tokens`` the total is fixed and a source
    gives what its cap allows. Shares of sources without texts fall to the
    others in proportion.

    Columns: mix_name, source, target_share, held (tokens of the source),
    max_repeats, budget, in_reach (the cap allows the share of the total).
    """
    w = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(0.0)  # NaN sorts above infinity
    merged = targets.filter("source IS NOT NULL").groupBy("mix_name", "source").agg(F.sum(w).alias("weight"), F.min("max_repeats").alias("max_repeats"))
    merged = merged.withColumn("max_repeats", F.when(F.col("max_repeats") < 0, 0).otherwise(F.col("max_repeats")))
    held = texts.groupBy("source").agg(F.sum("n_tokens").alias("held"))
    mix = Window.partitionBy("mix_name")
    known = merged.join(held, "source", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    known = known.withColumn("target_share", F.when(F.sum("weight").over(mix) > 0, F.col("weight") / F.sum("weight").over(mix)).otherwise(0.0))
    live = (F.col("weight") > 0) & (F.col("held") > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0)
    known = known.withColumn("live_weight", F.when(live, F.col("weight")).otherwise(0.0))
    known = known.withColumn("share", F.when(F.sum("live_weight").over(mix) > 0, F.col("live_weight") / F.sum("live_weight").over(mix)).otherwise(0.0))
    most = F.col("held").cast("double") * F.col("max_repeats")  # NULL: no cap
    if total_tokens is None:
        of_all = F.sum(F.when(live, F.col("held"))).over(mix)
        reachable = F.min(F.when(live, most / F.col("share"))).over(mix)
        known = known.withColumn("total", F.least(of_all.cast("double"), reachable))
        wanted = F.col("share") * F.coalesce("total", F.lit(0.0))
        in_reach = live | (F.col("weight") == 0)
    else:
        wanted = F.col("target_share") * F.lit(float(total_tokens))
        in_reach = (F.col("weight") == 0) | (live & (F.coalesce(most, wanted) >= wanted))
    budget = F.when(live, F.least(wanted, F.coalesce(most, wanted))).otherwise(0.0)
    return known.select("mix_name", "source", "target_share", "held", "max_repeats", F.floor(budget + 1e-6).cast("bigint").alias("budget"), in_reach.alias("in_reach"))


def _closest(rows: pd.DataFrame) -> pd.DataFrame:
    """Chooses, of the texts around the cut of one budget, those whose sizes come closest to what the others leave of it."""
    rows = rows.sort_values(["begins", "id", "n_tokens"], kind="stable").reset_index(drop=True)
    sizes = rows["n_tokens"].astype("int64")
    counts = {int(n): int(k) for n, k in sizes[sizes > 0].value_counts().items()}
    # the texts before those tried are used, and the first one tried begins where they end
    gap = int(rows["rest"].iloc[0] - rows["begins"].iloc[0])
    left = best_fill(sorted(counts), counts, gap, min(gap, max(counts, default=0)))  # a sum further beyond is no nearer than none
    chosen = []
    for n in sizes.tolist():
        chosen.append(int(left.get(n, 0) > 0))
        if chosen[-1]:
            left[n] -= 1
    return rows.assign(uses=(rows["rounds"] + chosen).astype("int32"))[["mix_name", "source", "id", "n_tokens", "uses"]]


def mix(placed: DataFrame, plan: DataFrame, around_tokens: int = AROUND_TOKENS) -> DataFrame:
    """The selection: mix_name, source, id, n_tokens, uses (how often the text is used).

    Each text is used once for each full round of its budget, and once more
    if it comes before the cut of the last round. A text across the cut would
    miss the budget by its length; so the texts that begin or end within
    ``around_tokens`` of the cut are chosen by the sum that comes closest to
    the budget (a subset-sum search over bitsets). A source, or a last round,
    of no more tokens than that gets the best sum that its whole texts allow.
    The search takes memory and time by ``around_tokens`` and the longest text
    near the cut, whatever the size of the source.
    """
    wanted = plan.filter("budget > 0 AND held > 0").select("mix_name", "source", "budget", "held")
    wanted = wanted.withColumn("rounds", F.floor(F.col("budget") / F.col("held"))).withColumn("rest", F.col("budget") - F.col("rounds") * F.col("held"))
    both = bounded_join(placed, wanted, ["source"], ["id"])
    before = F.col("begins") + F.col("n_tokens") <= F.col("rest") - around_tokens
    tried = (F.col("rest") > 0) & ~before & (F.col("begins") < F.col("rest") + around_tokens)
    names = ["mix_name", "source", "id", "n_tokens"]
    sure = both.filter(~tried).select(*names, (F.col("rounds") + (before & (F.col("rest") > 0)).cast("int")).cast("int").alias("uses"))
    near = both.filter(tried).select(*names, "begins", "rest", "rounds").groupBy("mix_name", "source").applyInPandas(_closest, sure.schema)
    return sure.unionByName(near).filter("uses > 0")


def share_report(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """Targets and what was reached, per mix and source, sources that give nothing included."""
    given = selection.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("uses").alias("most_uses")
    )
    mix_ = Window.partitionBy("mix_name")
    tokens = F.coalesce("tokens", F.lit(0))
    return (
        plan.join(given, ["mix_name", "source"], "left")
        .withColumn("tokens", tokens)
        .withColumn("actual_share", F.when(F.sum("tokens").over(mix_) > 0, F.col("tokens") / F.sum("tokens").over(mix_)).otherwise(0.0))
        .select("mix_name", "source", "target_share", "actual_share", "budget", "tokens", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats", "in_reach")
    )

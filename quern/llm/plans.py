"""Queries of the operators for language-model data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.distinct import count_sets, merge_runs, partial_sets, segment_bits
from quern.llm.mixing import budgets, mix, positions, share_report
from quern.llm.packing import fill_report, pack
from quern.llm.percentiles import DEFAULT_K, day_sketches, merge_sketches, percentiles
from quern.llm.tokens import token_counts
from quern.llm.topn import top_n
from quern.llm.visual import alike_pairs, form_classes, with_forms
from quern.operators.bounded import bounded_join
from quern.operators.materialize import materialize
from quern.sources.files import read_parquet

RANKS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of amount per region, for every month and all days, from sketches per day."""
    days = day_sketches(table(spark, sf_dir, "sales"), [F.col("region")], "amount", "sold_at")
    months = merge_sketches(days, ["region", F.date_format("day", "yyyy-MM").alias("span")])
    total = merge_sketches(months, ["region", F.lit("all").alias("span")])
    return percentiles(months.unionByName(total), RANKS)


#: Sketch widths that p2_rank_check tries, so that groups of all sizes are beyond some of them, and the ranks asked.
CHECKED_K = (32, 128, DEFAULT_K)
CHECKED_RANKS = {f"r{i}": i / 100 for i in (5, 10, 25, 50, 75, 90, 99)}


def p2_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sketch width: regions, values that count, whether all were counted, and whether the stated errors are kept.

    Each percentile of each region is ranked among all of the region's values.
    ``kept``: of the percentiles asked of more than k values, at least 99 % are
    within the error stated for 99 %; ``near``: all are within one and a half
    times of it; ``exact``: those asked of up to k values are exact.
    """
    sales = table(spark, sf_dir, "sales")
    rows = sales.filter("amount IS NOT NULL AND NOT isnan(amount)").select(F.coalesce("region", F.lit("NULL")).alias("region"), "amount", "id")
    out = None
    for k in CHECKED_K:
        days = day_sketches(sales, [F.coalesce("region", F.lit("NULL")).alias("region")], "amount", "sold_at", k)
        months = merge_sketches(days, ["region", F.date_trunc("month", "day").alias("month")])
        found = percentiles(merge_sketches(months, ["region"]), CHECKED_RANKS, k).withColumnRenamed("n", "counted")
        sums = []
        for name in CHECKED_RANKS:
            sums += [F.sum((F.col("amount") < F.col(name)).cast("long")).alias(f"{name}_below"), F.sum((F.col("amount") <= F.col(name)).cast("long")).alias(f"{name}_upto")]
        ranked = bounded_join(rows, found, ["region"], ["id", "amount"]).groupBy("region", "counted", "rank_error").agg(F.count(F.lit(1)).alias("n"), *sums)
        # how far the rank asked is from the ranks that the value has, as a share
        off = lambda name, rank: F.greatest(F.lit(0.0), F.col(f"{name}_below") / F.col("n") - rank, rank - F.col(f"{name}_upto") / F.col("n") - 1e-12)
        asked = ranked.select("n", "counted", "rank_error", F.explode(F.array(*(off(name, rank) for name, rank in CHECKED_RANKS.items()))).alias("off"))
        estimated, ranks = F.col("counted") > k, len(CHECKED_RANKS)
        part = asked.agg(
            F.lit(k).alias("k"),
            F.expr(f"count(1) div {ranks}").alias("regions"),
            F.expr(f"sum(n) div {ranks}").alias("n"),
            F.bool_and(F.col("n") == F.col("counted")).alias("complete"),
            (F.count_if(estimated & (F.col("off") > F.col("rank_error"))) <= 0.01 * F.count_if(estimated)).alias("kept"),
            F.bool_and(~estimated | (F.col("off") <= 1.5 * F.col("rank_error"))).alias("near"),
            F.bool_and(estimated | (F.col("off") <= 0)).alias("exact"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "sales"), ["region"], "amount", "id", 5).select("region", "id")


def p4_top_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "sales"), ["region"], "amount", "id", 5)


def p4_top_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred sales of highest amount, whatever their region."""
    return top_n(table(spark, sf_dir, "sales"), [], "amount", "id", 100)


def p5_distinct_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per day, per region, per month and over all days (sets of days), and per family of
    regions whose names begin alike (sets of regions): kind, set_key, n_distinct, collision_bound."""
    sales = table(spark, sf_dir, "sales")
    parts = materialize(partial_sets(sales, [F.col("region"), F.to_date("sold_at").alias("day")], "customer_id", segment_bits(sales.count())))
    as_set = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("set_key"))
    keys = ["kind", "set_key"]

    def of(sets: DataFrame, members: F.Column) -> DataFrame:
        return merge_runs(sets.select(F.explode(members).alias("s"), "segment", "run").select("s.*", "segment", "run"), keys)

    single = materialize(of(parts, F.array(as_set("day", F.col("day")), as_set("region", F.col("region")))))
    by_day = of(single.filter("kind = 'day'"), F.array(as_set("month", F.substring("set_key", 1, 7)), as_set("days", F.lit("all"))))
    by_region = of(single.filter("kind = 'region'"), F.array(as_set("regions", F.substring_index("set_key", "-", 1))))
    return count_sets(single.unionByName(by_day).unionByName(by_region), keys)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text").filter("n_tokens > 0"))
    return pack(sizes, table(spark, sf_dir, "containers"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-empty text in a container of each kind."""
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The selection, the plan it follows, and the sizes of all texts. Texts without a source can be no source's, and take no part."""
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", {"source": "source"})
    sizes = materialize(sizes.filter("n_tokens > 0 AND source IS NOT NULL"))
    plan = materialize(budgets(sizes, table(spark, sf_dir, "mix_targets"), total_tokens))
    return mix(materialize(positions(sizes)), plan), plan, sizes


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of every mix and how often each is used."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares, at the largest total at which sources reach theirs."""
    return share_report(*_mixed(spark, sf_dir)[:2])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = materialize(with_forms(table(spark, sf_dir, "documents"), "doc_id", "text", keep_form=False))
    return alike_pairs(forms).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text."""
    return with_forms(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "form")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shows something, with the class of texts that look like its own."""
    forms = materialize(with_forms(table(spark, sf_dir, "documents"), "doc_id", "text", keep_form=False))
    return form_classes(forms).withColumnRenamed("id", "doc_id")


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: texts placed, those not placed whole and once, containers that hold too much, and whether they are as few as can be.

    ``fewest``: no more containers than the least number that could hold the
    tokens, and one more for each window after the first, as stated.
    """
    sizes = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text").filter("n_tokens > 0"))
    packed = materialize(pack(sizes, table(spark, sf_dir, "containers")))
    kind = ["container_kind", "capacity_tokens"]
    fills = packed.groupBy(*kind, "container_id").agg(F.sum("n_tokens").alias("held"))
    least = F.ceil(F.sum("held") / F.first("capacity_tokens"))
    windows = F.count_distinct(F.shiftright("container_id", 32))
    containers = fills.groupBy(*kind).agg(
        F.sum((F.col("held") > F.col("capacity_tokens")).cast("bigint")).alias("overfull"), (F.count(F.lit(1)) <= least + windows - 1).alias("fewest")
    )
    texts = packed.groupBy(*kind, "id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"))
    split = F.col("pieces") != F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    whole = texts.join(sizes, "id").groupBy(*kind).agg(F.count(F.lit(1)).alias("texts"), F.sum((split | (F.col("placed") != F.col("n_tokens"))).cast("bigint")).alias("misplaced"))
    return containers.join(whole, kind).select("container_kind", "texts", "misplaced", "overfull", "fewest")


def expected_budgets(held: dict[str, int], targets: list[tuple[str, str, float | None, int | None]]) -> dict[tuple[str, str], float]:
    """Budgets by plain arithmetic: the most tokens at which each live source of a mix has its share; (mix, source) -> tokens."""
    out = {}
    for mix_name in {t[0] for t in targets}:
        live = [(s, w, cap) for m, s, w, cap in targets if m == mix_name and w is not None and 0 < w < float("inf") and held.get(s, 0) > 0 and (cap is None or cap > 0)]
        weights = sum(w for _, w, _ in live)
        total = min([float(sum(held[s] for s, _, _ in live)), *(cap * held[s] * weights / w for s, w, cap in live if cap is not None)])
        out |= {(mix_name, s): total * w / weights for s, w, _ in live}
    return out


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix: sources with a weight that have texts and those that have none, texts used too often, and whether budgets are met.

    Budgets are worked out anew from the sources' sizes (one row for each source
    of the targets). Each is met to within half of the source's longest text,
    which whole texts always allow; the tests hold small sources against the
    best of all subsets.
    """
    selection, _, sizes = _mixed(spark, sf_dir)
    targets = table(spark, sf_dir, "mix_targets")
    named = bounded_join(sizes, targets.select("source").distinct(), ["source"], ["id"], "left_semi")
    sources = named.groupBy("source").agg(F.sum("n_tokens").alias("held"), F.max("n_tokens").alias("longest"))
    sources = sources.collect()  # as many rows as the targets name sources
    given = {(r["mix_name"], r["source"]): r for r in selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("uses")).collect()}
    rows, held, longest = [], {r["source"]: r["held"] for r in sources}, {r["source"]: r["longest"] for r in sources}
    plain = [tuple(r) for r in targets.select("mix_name", "source", "weight", "max_repeats").collect()]
    budget = expected_budgets(held, plain)
    for mix_name in sorted({t[0] for t in plain}):
        of = [t for t in plain if t[0] == mix_name]
        wanted = [s for _, s, w, _ in of if w is not None and w > 0]
        tokens = {s: r["tokens"] for (m, s), r in given.items() if m == mix_name}
        over = sum(1 for m, s, _, cap in of if cap is not None and (m, s) in given and given[m, s]["uses"] > cap)
        met = set(tokens) <= {s for m, s in budget if m == mix_name} and all(abs(tokens.get(s, 0) - b) <= longest[s] / 2 + 1 for (m, s), b in budget.items() if m == mix_name)
        rows.append((mix_name, sum(s in held for s in wanted), sum(s not in held for s in wanted), over, met))
    return spark.createDataFrame(rows, "mix_name string, sources bigint, without_texts bigint, over_used bigint, budgets_met boolean")


# Latin letters and those of other alphabets that look the same; and the full-width forms of ASCII.
LATIN_LETTERS, OTHER_LETTERS = "aceopxyABEHKMOPTX", "асеорхуАВЕНКМОРТХ"
ASCII, WIDE = "".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xFF01, 0xFF5F)))

#: Changes that a reader can't see, and changes that one can, by Spark's own string functions (text in column t).
UNSEEN = {
    "wide": lambda t: F.translate(t, ASCII, WIDE),
    "other_letters": lambda t: F.translate(t, LATIN_LETTERS, OTHER_LETTERS),
    "blanks": lambda t: F.translate(t, " ", "\u00a0"),
    "invisible": lambda t: F.regexp_replace(t, "([a-zA-Z0-9 ])", "\u200b$1\u2060"),
    "stored_apart": lambda t: F.replace(F.replace(F.replace(t, F.lit("\u00e9"), F.lit("e\u0301")), F.lit("\u00fc"), F.lit("u\u0308")), F.lit("\u00f1"), F.lit("n\u0303")),
}
SEEN = {
    "case": lambda t: F.concat(F.lit("q"), t, F.lit("#")),  # against Q + text + #
    "accent": lambda t: F.concat(F.lit("Q\u0301"), t, F.lit("#")),
    "digit": lambda t: F.concat(F.lit("Q"), t, F.lit("#1")),
    "sign": lambda t: F.concat(F.lit("Q"), t, F.lit("?")),
    "raised": lambda t: F.concat(F.lit("Q"), t, F.lit("#\u00b2")),
    "blank": lambda t: F.concat(F.lit("Q "), t, F.lit("#")),
}


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: texts, changes that can't be seen after which the form is the same, changes that can be seen after which
    it differs (each text under each change, made by Spark's string functions), and forms that change when they are formed again."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "lang", F.concat(F.lit("Q"), "text", F.lit("#")).alias("t"))
    changes = F.array(*(F.struct(F.lit(i < len(UNSEEN)).alias("alike"), change(F.col("t")).alias("text")) for i, change in enumerate([*UNSEEN.values(), *(lambda t, c=c: c(F.expr("substring(t, 2, length(t) - 2)")) for c in SEEN.values())])))
    plain = with_forms(docs, "doc_id", "t").select(F.col("id").alias("doc_id"), "form", "form_key")
    changed = docs.select("doc_id", F.explode(changes).alias("c")).select(F.struct("doc_id", "c.alike").alias("key"), "c.text")
    formed = with_forms(changed, "key", "text", keep_form=False).select("id.doc_id", "id.alike", F.col("form_key").alias("other"))
    again = with_forms(materialize(plain), "doc_id", "form", keep_form=False).select(F.col("id").alias("doc_id"), F.col("form_key").alias("again"))
    per_text = formed.join(plain, "doc_id").groupBy("doc_id").agg(
        F.count_if(F.col("alike") & (F.col("other") == F.col("form_key"))).alias("same"), F.count_if(~F.col("alike") & (F.col("other") != F.col("form_key"))).alias("different")
    )
    both = docs.select("doc_id", "lang").join(per_text, "doc_id").join(plain.select("doc_id", "form_key").join(again, "doc_id"), "doc_id")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("same").alias("same"), F.sum("different").alias("different"), F.count_if(F.col("form_key") != F.col("again")).alias("unstable"))


def _distinct_sql(kind: str, key: str) -> str:
    return f"SELECT '{kind}' AS kind, {key} AS set_key, count(DISTINCT customer_id) AS n_distinct FROM sales WHERE customer_id IS NOT NULL GROUP BY ALL"


_TOP = """SELECT region, id, amount FROM (SELECT DISTINCT region, id, amount FROM sales WHERE amount IS NOT NULL AND NOT isnan(amount))
QUALIFY row_number() OVER (PARTITION BY region ORDER BY amount DESC, id) <= 5"""

QUERIES = {
    "p2_percentiles": p2_percentiles,
    "p2_rank_check": p2_rank_check,
    "p4_found": p4_found,
    "p4_top_amounts": p4_top_amounts,
    "p4_top_overall": p4_top_overall,
    "p5_distinct_customers": p5_distinct_customers,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_check": p6_check,
    "p7_selection": p7_selection,
    "p7_shares": p7_shares,
    "p7_check": p7_check,
    "p8_found": p8_found,
    "p8_forms": p8_forms,
    "p8_classes": p8_classes,
    "p8_check": p8_check,
}

SQL = {
    "p2_rank_check": f"""SELECT k, count(*) AS regions, CAST(sum(n) AS BIGINT) AS n, true AS complete, true AS kept, true AS near, true AS exact
        FROM (SELECT count(*) AS n FROM sales WHERE amount IS NOT NULL AND NOT isnan(amount) GROUP BY region), (VALUES {', '.join(f'({k})' for k in CHECKED_K)}) t(k) GROUP BY k""",
    "p6_check": """SELECT container_kind, (SELECT count(*) FROM documents WHERE length(text) > 0) AS texts, 0::BIGINT AS misplaced,
        0::BIGINT AS overfull, true AS fewest FROM containers""",
    "p7_check": """WITH t AS (SELECT DISTINCT source FROM documents WHERE length(text) > 0)
        SELECT m.mix_name, count(*) FILTER (WHERE weight > 0 AND t.source IS NOT NULL) AS sources,
        count(*) FILTER (WHERE weight > 0 AND t.source IS NULL) AS without_texts, 0::BIGINT AS over_used, true AS budgets_met
        FROM mix_targets m LEFT JOIN t ON m.source = t.source GROUP BY m.mix_name""",
    "p8_check": f"""SELECT lang, count(*) AS texts, {len(UNSEEN)} * count(*) AS same, {len(SEEN)} * count(*) AS different, 0::BIGINT AS unstable
        FROM documents WHERE text IS NOT NULL GROUP BY lang""",
    "p4_top_overall": """SELECT id, amount FROM (SELECT DISTINCT id, amount FROM sales WHERE amount IS NOT NULL AND NOT isnan(amount))
        ORDER BY amount DESC, id LIMIT 100""",
    "p4_found": f"SELECT region, id FROM ({_TOP})",
    "p4_top_amounts": _TOP,
    "p5_distinct_customers": "SELECT *, CAST(n_distinct AS DOUBLE) * (n_distinct - 1) / 36893488147419103232.0::DOUBLE AS collision_bound FROM ("
    + " UNION ALL ".join(
        [
            _distinct_sql("day", "strftime(sold_at, '%Y-%m-%d')"),
            _distinct_sql("region", "region"),
            _distinct_sql("month", "strftime(sold_at, '%Y-%m')"),
            _distinct_sql("days", "'all'"),
            _distinct_sql("regions", "split_part(region, '-', 1)"),
        ]
    )
    + ")",
}

"""The general large-scale operators against brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import balanced, bitmaps, orphans
from quern.operators.arrowruns import Boundaries
from quern.operators.balanced import balanced_group_by, exchange_counts, heavy_keys
from quern.operators.bounded import HotKeys, bounded_join
from quern.operators.materialize import materialize, scratch
from quern.operators.sizing import advisory_bytes, partitions_for, source_bytes
from quern.operators.orphans import References, dense_codes, find_orphans, orphan_report


def test_boundaries_across_batches():
    borders = Boundaries()
    assert borders.starts([pa.array(["a", "a", None]), pa.array([1, 1, 1])]).tolist() == [True, False, True]
    assert borders.starts([pa.array([None, None, "b"]), pa.array([1, 2, 2])]).tolist() == [False, True, True]


@pytest.mark.parametrize("size", [0, 1, 50, 5000, 40000, 65536])
@pytest.mark.parametrize("dense", [False, True])
def test_bitmaps_round_trip(size, dense):
    rng = np.random.default_rng(size)
    low = np.arange(size) if dense else rng.choice(bitmaps.BITS, size, replace=False)
    packed = bitmaps.pack(low)
    assert np.array_equal(np.flatnonzero(bitmaps.unpack(packed)), np.sort(low))
    assert len(packed) <= 1 + bitmaps.BITS // 8


def test_bitmaps_and_not():
    a, b = bitmaps.pack(np.array([1, 5, 9])), bitmaps.pack(np.array([5]))
    assert bitmaps.and_not(a, b).tolist() == [1, 9]
    assert bitmaps.and_not(a, None).tolist() == [1, 5, 9] and bitmaps.and_not(None, b).tolist() == []


def counted(rows, keys, value):
    found = defaultdict(lambda: [0, 0.0, 0])
    for row in rows:
        cell = found[tuple(row[k] for k in keys)]
        cell[0] += 1
        if row[value] is not None:
            cell[1], cell[2] = cell[1] + row[value], cell[2] + 1
    return {k: (n, round(s, 6) if c else None) for k, (n, s, c) in found.items()}


def test_balanced_group_by_on_skewed_keys(spark):
    rng = random.Random(1)
    odd = ["a|b", "a\x1fb", "\x1b", "~", "=x", "", "null", None, "a\x1b2b"]
    rows = [(rng.choice([7] * 8 + [None, *range(100)]), rng.choice(odd), rng.choice([None, 1.5, 2.0])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, s string, v double").withColumn("n", F.lit("clash")).withColumn("total", F.lit(1)).repartition(5)
    got = {(r["k"], r["s"]): (r["n"], None if r["total"] is None else round(r["total"], 6)) for r in balanced_group_by(df, ["k", "s"], "v", 6).collect()}
    assert got == counted(rows, (0, 1), 2)
    assert {r["s"]: r["n"] for r in balanced_group_by(df, ["s"]).collect()} == {k[0]: n for k, (n, _) in counted(rows, (1,), 2).items()}


def test_balanced_one_key_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr("quern.operators.balanced.CHUNK_ROWS", 10)
    df = spark.range(5000).select(F.lit("only").alias("k"), F.lit(1.0).alias("v")).repartition(8)
    written = []
    monkeypatch.setattr(balanced, "materialize", lambda frame: written.append(materialize(frame)) or written[0])
    assert [tuple(r) for r in balanced_group_by(df, ["k"], "v", 8).collect()] == [("only", 5000, 5000.0)]
    parts = sorted(r["n"] for r in written[0].filter("edge").collect())
    assert len(parts) >= 5 and parts[-1] < 2500  # the one key is spread, and no task has most of it


@pytest.mark.parametrize("marks", [1, 3])
def test_balanced_keys_that_share_a_hash(spark, monkeypatch, marks):
    monkeypatch.setattr("quern.operators.balanced.CHUNK_ROWS", 10)
    true_marks = balanced.key_marks
    monkeypatch.setattr(balanced, "key_marks", lambda keys: true_marks(keys) % marks)
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.lit(1.0).alias("v")).repartition(8)
    want = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    for batch in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = balanced_group_by(rows, ["k"], "v", 8).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(found) == len(want) and {r["k"]: r["n"] for r in found} == want and all(r["total"] == r["n"] for r in found)


def test_bounds_balance_states():
    """A key with half of all rows in 1000 chunks, light keys, and a grouping of few keys."""
    rng = np.random.default_rng(2)
    marks = rng.integers(-(2**63), 2**63 - 1, 40_000)
    rows = [np.where(rng.random(200_000) < 0.5, marks[0], rng.choice(marks, 200_000)), rng.choice(marks[:3], 200_000)]
    share, chunks = 0.02, {1: 1000, 2: 1000}
    sample = pd.concat([pd.DataFrame({"grouping": g, "mark": r[rng.random(len(r)) < share], "n": 1, "task": 0}) for g, r in zip((1, 2), rows, strict=True)])
    bounds = balanced.sampled_bounds(sample, share, chunks, 20)
    sizes, seen = np.zeros(20), {}
    for chunk in range(1000):
        for g, r in zip((1, 2), rows, strict=True):
            own = np.unique(r[chunk::1000])
            place, edge = bounds.place(g, own, balanced.chunk_order(chunk % 7, chunk // 7))
            sizes += np.bincount(place, minlength=20)
            for m, p, e in zip(own.tolist(), place.tolist(), edge.tolist(), strict=True):
                seen.setdefault((g, m), set()).add((p, e))
    assert sizes.max() < 2 * sizes.mean() and sizes.min() > 0
    assert all(len({e for _, e in found}) == 1 and (len(found) == 1 or all(e for _, e in found)) for found in seen.values())
    nothing = balanced.sampled_bounds(sample[:0], share, chunks, 20)
    assert nothing.place(1, marks[:5], 7)[0].tolist() == [0] * 5


def test_partitions_follow_the_size(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    size = source_bytes(spark.read.parquet(str(tmp_path / "t")).filter("id > 5"))
    assert 1000 < size < 100_000
    assert partitions_for(spark, None) == partitions_for(spark, size) == 4
    assert partitions_for(spark, 100 * advisory_bytes(spark)) == 100


def test_balanced_key_types(spark):
    df = spark.sql("SELECT * FROM VALUES (0.0D, true, date'2024-01-01', 1.50BD, array(1), X'00FF'), (-0.0D, true, date'2024-01-01', 1.50BD, array(1), X'00FF'), (NULL, NULL, NULL, NULL, NULL, NULL), (double('nan'), false, date'2024-01-02', 2.00BD, array(2), X'01') AS t(f, b, d, e, a, x)")
    found = balanced_group_by(df, df.columns)
    assert found.dtypes[:-1] == df.dtypes
    rows = found.collect()
    assert sorted(r["n"] for r in rows) == [1, 1, 2]
    assert {repr(r["f"]) for r in rows} == {"0.0", "nan", "None"}


def test_balanced_empty_and_long(spark):
    assert balanced_group_by(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0
    long = "x" * 300_000
    assert balanced_group_by(spark.createDataFrame([(long,), (long,)], "k string"), ["k"]).collect()[0]["n"] == 2


def test_balanced_nan_and_null_values(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("b", None)], "k string, v double")
    got = {r["k"]: r["total"] for r in balanced_group_by(df, ["k"], "v").collect()}
    assert got["a"] != got["a"] and got["b"] is None


def test_exchange_counts(spark):
    table = spark.createDataFrame([(1, None, 2.0), (1, "b", None), (1, None, 3.0)], "id bigint, key string, amount double")
    plans = spark.createDataFrame([(1, "t", [1, 0]), (2, "t", [0]), (3, "none", [0]), (4, "t", [9]), (5, "t", None), (6, "t", []), (7, None, [0])], "exchange_id bigint, input_table string, key_columns array<bigint>")
    with pytest.warns(UserWarning, match="exchange . on columns"):
        found = exchange_counts(spark, plans, lambda name: table if name == "t" else None)
    rows = {(r["exchange_id"], r["key_text"]): (r["n"], r["total"]) for r in heavy_keys(found).collect()}
    assert rows == {(1, "null|1"): (2, 5.0), (1, "b|1"): (1, None), (2, "1"): (3, 5.0), (6, ""): (3, 5.0)}
    with pytest.warns(UserWarning, match="exchange 3"):
        assert exchange_counts(spark, plans.filter("exchange_id = 3"), lambda name: None).count() == 0


def test_written_tables_go_with_their_scope(spark):
    kept = materialize(spark.range(3))
    with scratch():
        inside = materialize(spark.range(5))
        assert inside.count() == 5
    assert kept.count() == 3
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|PATH_NOT_FOUND"):
        inside.count()


def test_hot_keys_are_split_by_their_counts(spark, monkeypatch):
    monkeypatch.setattr("quern.operators.bounded.TASK_ROWS", 10)
    rows = spark.createDataFrame([(i, "hot" if i < 95 else None if i < 120 else f"k{i % 7}") for i in range(150)], "id bigint, k string")
    hot = HotKeys(rows, ["k"])
    assert sorted(r["hot_parts"] for r in hot.parts.collect()) == [3, 10]
    parts = {k: {r["part"] for r in hot.split(rows, ["id"]).filter(F.col("k").eqNullSafe(k)).collect()} for k in ("hot", None, "k1")}
    assert parts["hot"] <= set(range(10)) and len(parts["hot"]) >= 8 and parts[None] == {0, 1, 2} and parts["k1"] == {0}
    copies = hot.copy(spark.createDataFrame([("hot",), ("k1",), (None,)], "k string"))
    assert sorted((r["k"] or "", r["part"]) for r in copies.collect()) == sorted([("hot", i) for i in range(10)] + [("k1", 0)] + [("", i) for i in range(3)])
    monkeypatch.setattr("quern.operators.bounded.HOT_KEYS", 2)  # at most two keys in parts, so parts of 75 rows
    assert [r["hot_parts"] for r in HotKeys(rows, ["k"]).parts.collect()] == [2]
    monkeypatch.setattr("quern.operators.bounded.TASK_ROWS", 150)
    assert HotKeys(rows, ["k"]).parts is None


def test_bounded_join_both_ways(spark, monkeypatch):
    rows, small = spark.createDataFrame([(i, i % 3) for i in range(50)], "id bigint, k bigint"), spark.createDataFrame([(0, "x"), (1, "y")], "k bigint, name string")
    want = sorted((i % 3, i, "xy"[i % 3]) for i in range(50) if i % 3 < 2)
    assert sorted(map(tuple, bounded_join(rows, small, ["k"], ["id"]).select("k", "id", "name").collect())) == want
    monkeypatch.setattr("quern.operators.bounded.BROADCAST_BYTES", 1)
    for task_rows in (1 << 20, 4):
        monkeypatch.setattr("quern.operators.bounded.TASK_ROWS", task_rows)
        assert sorted(map(tuple, bounded_join(rows, small, ["k"], ["id"]).select("k", "id", "name").collect())) == want


@pytest.mark.parametrize("values", [[5, 3, 3, None, 9], ["b", "a", None], []])
def test_dense_codes(spark, values):
    kind = "string" if values and isinstance(values[0], str) else "bigint"
    rows = dense_codes(spark.createDataFrame([(v,) for v in values], f"key {kind}")).collect()
    want = sorted({v for v in values if v is not None})
    assert sorted((r["code"], r["key"]) for r in rows) == list(enumerate(want))


DAY = datetime(2024, 3, 1)
PARENTS = "customer_id bigint, created_at timestamp_ntz, deleted_at timestamp_ntz"
REFS = "id bigint, customer_id bigint, at timestamp_ntz, name string, period string, record bigint"


def brute(refs, parents):
    out = set()
    for record, key, at, *_ in refs:
        if key is not None and not any(k == key and c is not None and at is not None and c <= at and (d is None or d > at) for k, c, d in parents):
            out.add(("t", at.strftime("%Y-%m") if at else None, record))
    return out


@pytest.mark.parametrize(("block", "sent", "task_rows"), [(64, 1 << 20, 1 << 20), (2, 0, 3)])
def test_orphans_against_brute_force(spark, monkeypatch, block, sent, task_rows):
    monkeypatch.setattr(orphans, "PERIOD_BLOCK", block)
    monkeypatch.setattr("quern.operators.bounded.BROADCAST_BYTES", sent)
    monkeypatch.setattr("quern.operators.bounded.TASK_ROWS", task_rows)
    rng = random.Random(3)
    parents = []
    for key in [*range(1, 40), *range(1, 20)]:
        begin = DAY + timedelta(hours=rng.randrange(-3000, 3000))
        parents.append((rng.choice([key, key, None]) if key > 30 else key, rng.choice([begin, begin, begin, None]), rng.choice([None, begin + timedelta(hours=rng.randrange(1, 3000))])))
    parents += parents[:5]
    refs = []
    for i in range(400):
        at = DAY + timedelta(hours=rng.randrange(-2000, 2000))
        refs.append((i, rng.choice([None, 7, 7, *range(1, 50)]), rng.choice([at] * 9 + [None]), "x", "y", 0))
    refs += refs[:50]
    # many records and parents of one key within one hour
    for i in range(40):
        refs.append((3000 + i, 950, DAY + timedelta(seconds=rng.randrange(3600)), "", "", 0))
        parents.append((950, DAY + timedelta(seconds=rng.randrange(3600)), DAY + timedelta(seconds=rng.randrange(3600))))
    parents.append((950, DAY - timedelta(hours=5), DAY + timedelta(minutes=7)))
    refs.append((2000, 900, datetime(9999, 12, 31), "", "", 0))
    # times on the borders of a month and of a parent's span
    parents.append((900, datetime(2024, 4, 1), datetime(2024, 5, 1)))
    refs += [(1000, 900, datetime(2024, 4, 1), "", "", 0), (1001, 900, datetime(2024, 5, 1), "", "", 0), (1002, 900, datetime(2024, 4, 30, 23, 59, 59, 999999), "", "", 0), (1003, 900, datetime(2024, 3, 31, 23, 59, 59, 999999), "", "", 0)]
    found = find_orphans([References("t", spark.createDataFrame(refs, REFS), "id", "customer_id", "at")], spark.createDataFrame(parents, PARENTS), "customer_id", "created_at", "deleted_at")
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(refs, parents)
    assert sum(r["orphans"] for r in orphan_report(found).collect()) == len(rows)


def test_orphans_when_clocks_change(spark):
    """Times with a zone: the hour that comes twice, in Berlin on 2024-10-27, and the one that is left out."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        at = lambda rows, names: spark.createDataFrame(rows, "k bigint, a string, b string").select("k", *(F.to_timestamp(c).alias(n) for c, n in zip("ab", names)))
        parents = at([(1, "2024-10-27T00:40:00Z", "2024-10-27T01:10:00Z"), (1, "2024-03-31T00:30:00Z", "2024-03-31T01:30:00Z")], ["since", "until"])
        times = ["2024-10-27T00:30:00Z", "2024-10-27T00:50:00Z", "2024-10-27T01:05:00Z", "2024-10-27T01:20:00Z", "2024-03-31T00:10:00Z", "2024-03-31T00:45:00Z", "2024-03-31T01:15:00Z", "2024-03-31T01:45:00Z"]
        refs = at([(1, t, t) for t in times], ["at", "copy"]).withColumn("id", F.unix_timestamp("at"))
        found = find_orphans([References("t", refs, "id", "k", "at")], parents, "k", "since", "until")
        want = {datetime.fromisoformat(times[i]).timestamp() for i in (0, 3, 4, 7)}
        assert {float(r["record_id"]) for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_orphans_of_empty_tables(spark):
    none, some = spark.createDataFrame([], REFS), spark.createDataFrame([(1, 5, DAY, "", "", 0)], REFS)
    parents = spark.createDataFrame([], PARENTS)
    of = lambda refs: [tuple(r) for r in find_orphans([References("t", refs, "id", "customer_id", "at")], parents, "customer_id", "created_at", "deleted_at").collect()]
    assert of(none) == [] and of(some) == [("t", "2024-03", 1)]


def test_orphans_with_text_keys_and_a_hot_key(spark):
    refs = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("ref"), F.lit(DAY).cast("timestamp_ntz").alias("at"))
    parents = spark.createDataFrame([(f"k{i}", DAY - timedelta(days=1), None) for i in range(49)], "ref string, since timestamp_ntz, until timestamp_ntz")
    found = find_orphans([References("t", refs, "id", "ref", "at")], parents, "ref", "since", "until")
    want = {i for i in range(3000) if i % 3 == 0 or i % 50 == 49}
    assert {r["record_id"] for r in found.collect()} == want
    with pytest.raises(TypeError):
        find_orphans([References("t", refs, "id", "id", "at")], parents, "ref", "since", "until")

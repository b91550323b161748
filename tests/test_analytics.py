"""Overlaps, global order, quantiles, funnels, distinct counts, frequent values, grids, as-of slices, layouts."""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tidemill.operators import distinct, funnels, gaps, ordering, overlaps, skew, temporal
from tidemill.plans import analytics

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_are_each_pair_once(spark):
    rng = random.Random(5)

    def some(n, tag):
        out = []
        for i in range(n):
            s = rng.randrange(-5000, 5000)
            out.append((rng.choice("ab") if i % 9 else None, i, s, s + rng.choice((0, 0, 1, 3, 63, 64, 65, 900, 20_000, -4))))
        return out + [("a", n, None, 5), ("a", n + 1, 5, None), ("b", n + 2, 0, 4), ("b", n + 3, 0, 4)], f"k string, {tag} long, s{tag} long, e{tag} long"

    (x, xs), (y, ys) = some(150, "x"), some(130, "y")
    for base in (1, 64, 10**6):
        got = overlaps.overlap_join(spark.createDataFrame(x, xs), spark.createDataFrame(y, ys), ["k"], ("sx", "ex"), ("sy", "ey"), base)
        want = sorted((a[1], b[1]) for a in x for b in y if a[0] and a[0] == b[0] and None not in a[2:] + b[2:] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3])
        assert sorted((r.x, r.y) for r in got.collect()) == want
    empty = spark.createDataFrame([], ys)
    assert overlaps.overlap_join(spark.createDataFrame(x, xs), empty, ["k"], ("sx", "ex"), ("sy", "ey")).count() == 0


def test_overlaps_of_few_need_no_bins(spark, monkeypatch):
    """Keys with few pairs meet without a row for each bin, keys with many by bins, with the same pairs."""
    rng = random.Random(11)

    def some(n, tag):
        out = [("hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{rng.randrange(20)}", i, s := rng.randrange(3000), s + rng.choice((-1, 0, 1, 40, 700, 9000))) for i in range(n)]
        return spark.createDataFrame([*out, ("alone" + tag, n, 0, 5)], f"k string, {tag} long, s{tag} long, e{tag} long"), out

    (x, xs), (y, ys) = some(200, "x"), some(160, "y")
    want = sorted((a[1], b[1]) for a in xs for b in ys if a[0] and a[0] == b[0] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3])
    binned = {}
    for pairs in (0, 200, 1 << 14):
        monkeypatch.setattr(overlaps, "PAIRS", pairs)
        got = overlaps.overlap_join(x, y, ["k"], ("sx", "ex"), ("sy", "ey"), 64)
        assert got.columns == ["k", "x", "sx", "ex", "y", "sy", "ey"]
        assert sorted((r.x, r.y) for r in got.collect()) == want
        binned[pairs] = "Generate" in got._jdf.queryExecution().optimizedPlan().toString()
    assert binned == {0: True, 200: True, 1 << 14: False}


def test_long_intervals_stay_few_rows(spark):
    """An interval a million bins long meets short ones without a row for each bin."""
    long = spark.createDataFrame([("a", 0, 0, 10**12)], "k string, x long, sx long, ex long")
    short = spark.range(500).select(F.lit("a").alias("k"), F.col("id").alias("y"), (F.col("id") * 10**9).alias("sy"), (F.col("id") * 10**9 + 5).alias("ey"))
    got = overlaps.overlap_join(long, short, ["k"], ("sx", "ex"), ("sy", "ey"), base=1)
    assert got.count() == 500
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 4


def test_numbers_and_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice((1, 1, 1, 1, 2, 7, None)), i, rng.randrange(100) if i % 5 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "a long, i long, v long").repartition(7)
    got = sorted((r.row_number, r.i, r.running_total) for r in ordering.numbered(df, ["a", "i"], "v", parts=5).collect())
    total, want = 0, []
    for k, (_, i, v) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1):
        total += v or 0
        want.append((k, i, total))
    assert got == want
    assert ordering.numbered(df.limit(0), ["a"]).count() == 0
    assert "SinglePartition" not in plan(ordering.numbered(df, ["a", "i"], "v").drop("running_total")).split("Scan parquet")[0].split("BroadcastExchange")[0]


def test_quantiles_are_exact(spark):
    rng = random.Random(8)
    rows = [(g, v) for g, n in (("x", 3000), ("y", 11), (None, 400), ("z", 1), ("t", 2000)) for v in ((rng.random() * 100 if g != "t" else rng.choice((1.0, 2.0, 2.0, 2.0, 5.0))) for _ in range(n))]
    rows += [("x", None), ("x", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    for by, accuracy in ((["g"], 1000), (["g"], 10), ([], 20)):
        got = ordering.quantiles(df, by, "v", at, accuracy).collect()
        groups = {}
        for g, v in rows:
            if v is not None and v == v:
                groups.setdefault(g if by else 0, []).append(v)
        assert len(got) == len(at) * len(groups)
        for r in got:
            x = sorted(groups[r.g if by else 0])
            p = r.q * (len(x) - 1)
            lo = math.floor(p)
            cont = x[lo] + (x[min(lo + 1, len(x) - 1)] - x[lo]) * (p - lo)
            assert r.n == len(x) and r.discrete == x[max(1, math.ceil(r.q * len(x))) - 1] and abs(r.continuous - cont) < 1e-9
    assert ordering.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def brute_funnel(events, steps, within):
    best = {}
    for u, rows in events.items():
        rows = sorted(rows)
        level = 0
        for a, (t0, _, k0) in enumerate(rows):
            if k0 != steps[0]:
                continue
            n = 1
            for t, _, k in rows[a + 1 :]:
                if t - t0 <= within and n < len(steps) and k == steps[n]:
                    n += 1
            level = max(level, n)
        best[u] = level
    return best


def test_funnel_over_slots(spark):
    rng = random.Random(3)
    rows = [(u, rng.randrange(0, 400_000), i, rng.choice("abcx")) for i, u in enumerate(rng.choices(range(40), k=700))] + [(99, 1, 0, "x"), (None, 5, 1, "a")]
    df = spark.createDataFrame(rows, "u long, s long, i long, k string").withColumn("t", F.timestamp_seconds("s"))
    for steps, within, slot in ((["a", "b", "c"], 20_000, 20_000), (["a", "b", "c"], 20_000, None), (["a", "c"], 500, 1000), (["b", "a", "c", "x"], 60_000, 70_000)):
        got = {r.u: r.level for r in funnels.funnel(df, ["u"], "t", "k", steps, within, "i", slot).collect()}
        events = {}
        for u, s, i, k in rows:
            if u is not None:
                events.setdefault(u, []).append((s, i, k))
        assert got == brute_funnel(events, steps, within)
    assert funnels.funnel(df.limit(0), ["u"], "t", "k", ["a"], 1).count() == 0


def test_bitmaps_add_up(spark):
    rows = [(d, u) for d in range(6) for u in range(-50_000 + d, 50_000, 977 + d)] * 2 + [(1, None)]
    df = spark.createDataFrame(rows, "d int, u long").repartition(5)
    days = distinct.bitmaps(df, ["d"], "u")
    got = {r.d: r.uniques for r in distinct.counted(days, ["d"]).collect()}
    assert got == {d: len({u for e, u in rows if e == d and u is not None}) for d in range(6)}
    halves = distinct.counted(distinct.rolled_up(days, [(F.col("d") % 2).alias("h")]), ["h"])
    assert {r.h: r.uniques for r in halves.collect()} == {h: len({u for e, u in rows if e % 2 == h and u is not None}) for h in (0, 1)}


def test_frequent_values_within_the_stated_bound(spark):
    rng = random.Random(6)
    values = [f"v{min(int(rng.paretovariate(0.7)), 5000)}" for _ in range(20_000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "w string").repartition(6)
    counts = Counter(v for v in values if v)
    n = sum(counts.values())
    for share, tracked in ((0.01, None), (0.05, 128), (0.002, None)):
        got, named = distinct.frequent(df, "w", share, tracked)
        assert {r.value: r.n for r in got.collect()} == {v: c for v, c in counts.items() if c > share * n}
        bound = 3.5 / (tracked or 1 << (int(16 / share) - 1).bit_length()) * n
        assert all(abs(r.estimate - counts[r.value]) <= bound for r in named.collect())
    assert distinct.frequent(df.limit(0), "w", 0.1)[0].count() == 0


def test_grids(spark):
    rows = [("a", 0, 1.0), ("a", 3, 4.0), ("a", 4, 0.0), ("a", 9, 5.0), ("b", 7, 2.0), ("a", None, 1.0), ("b", 8, None)]
    df = spark.createDataFrame(rows, "k string, s long, v double")
    for part in (4096, 2, 1):
        got = {(r.k, r.s): (r.v, r.last, r.next, round(r.linear, 9)) for r in gaps.filled(df, ["k"], "s", "v", part).collect()}
        assert len(got) == 11 and got["b", 7] == (2.0, 2.0, 2.0, 2.0)
        assert got["a", 1] == (None, 1.0, 4.0, 2.0) and got["a", 3] == (4.0, 4.0, 4.0, 4.0) and got["a", 6] == (None, 0.0, 5.0, 2.0) and got["a", 9] == (5.0, 5.0, 5.0, 5.0)


def test_asof_in_slices_is_asof(spark):
    rng = random.Random(9)
    a = spark.createDataFrame([(rng.choice((1, 2, None)), rng.randrange(1000), i) for i in range(200)], "u long, s long, i long").withColumn("t", F.timestamp_seconds("s"))
    b = spark.createDataFrame([(rng.choice((1, 2, 3, None)), rng.randrange(1000), i) for i in range(60)], "u long, s2 long, j long").withColumn("t2", F.timestamp_seconds("s2"))
    whole = sorted(map(tuple, temporal.asof_join(a, b, ["u"], "t", "t2", ["j"]).collect()), key=repr)
    for seconds in (1, 37, 5000):
        assert sorted(map(tuple, temporal.asof_join(a, b, ["u"], "t", "t2", ["j"], seconds).collect()), key=repr) == whole


def test_layout_saves_exchanges(spark):
    df = analytics.bucketed_join(spark, DATA)
    df.collect()
    assert "Exchange" not in plan(df)
    df = analytics.pruned_partitions(spark, DATA)
    assert "dynamicpruning" in plan(df)
    got = df.collect()
    scan = plan(df)
    assert len(got) and "Exchange" in scan


def test_buckets_go_by_lines(spark, monkeypatch):
    """Twice as many lines have twice as many buckets, each of as many lines as before."""
    want = sorted(map(tuple, analytics.bucketed_join(spark, DATA).collect()))
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    monkeypatch.setattr(analytics, "BUCKET_ROWS", 500)
    df = analytics.bucketed_join(spark, DATA)
    assert sorted(map(tuple, df.collect())) == want
    assert "Exchange" not in plan(df) and f"{-(-lines // 500)} out of {-(-lines // 500)}" in plan(df)


def test_salts_are_the_same_whenever_a_task_runs(spark):
    df = spark.createDataFrame([(1, f"x{i}") for i in range(400)] + [(None, f"n{i}") for i in range(300)] + [(k, "y") for k in range(2, 90)], "k long, v string")
    right = spark.createDataFrame([(1, "a"), (5, "b"), (None, "z")], "k long, w string")
    want = sorted(map(tuple, df.join(right, "k", "left").collect()), key=repr)
    for order in ("v", "k"):
        assert sorted(map(tuple, skew.salted_join(df.orderBy(order), right, "k", 4, "left").collect()), key=repr) == want
    text = skew.salted_join(df, right, "k", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "rand(" not in text and "xxhash64" in text

"""As-of joins, resetting sums and sketches against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.operators import patterns as P
from corvane.operators import timeline as T


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("width", [3, 1000])
def test_as_of_over_slices(spark, forward, width):
    rng = random.Random(width)
    left = [(rng.choice("abc"), rng.randint(-50, 150), i) for i in range(80)] + [("a", None, 900), (None, 5, 901), ("d", 5, 902)]
    right = [(rng.choice("abc"), rng.choice([1, 4, 60, 61, rng.randint(0, 100)]), f"v{i}", i) for i in range(40)] + [(None, 1, "none", 1), ("a", None, "never", 2)]
    l_df, r_df = spark.createDataFrame(left, "k string, at bigint, n int"), spark.createDataFrame(right, "k string, at bigint, v string, o int")
    for within in (None, 5):
        want = []
        for k, at, n in left:
            able = [] if at is None or k is None else [(t, o, v) for x, t, v, o in right if x == k and t is not None and (t >= at if forward else t <= at) and (within is None or abs(t - at) <= within)]
            want.append((k, at, n, (min(able) if forward else max(able))[2] if able else None))
        got = T.as_of(l_df, r_df, ["k"], "at", "v", width=width, order="o", within=within, forward=forward)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [4, 10_000])
def test_resets_follow_the_order(spark, width):
    rng = random.Random(7)
    rows = [(k, i, rng.choice([0, 1, 2, 3, 5, 8, 30, None, -4])) for k in "abc" for i in range(-5, 120)] + [("d", 1, 1), ("e", 1, 100), ("e", 2, 100), (None, 1, 100), ("a", None, 100)]
    rng.shuffle(rows)
    used, nth, want = defaultdict(int), defaultdict(int), []
    for k, i, amount in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1])):
        used[k] += max(amount or 0, 0)
        if used[k] >= 20:
            nth[k] += 1
            want.append((k, nth[k], i, used[k]))
            used[k] = 0
    df = spark.createDataFrame(rows, "k string, at bigint, amount int").repartition(5)
    assert sorted(map(tuple, T.resets(df, ["k"], "at", "amount", 20, width=width).collect())) == want
    assert T.resets(df.limit(0), ["k"], "at", "amount", 20, width=width).isEmpty()


def test_sketches_merge_and_say_their_error(spark):
    df = spark.range(20_000).select((F.col("id") % 14).alias("day"), F.concat(F.lit("m"), (F.col("id") % 7 * (F.col("id") % 3)).cast("string")).alias("item"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("v"))
    days = P.sketches(df, F.col("day"), F.col("item"), F.col("v"))
    weeks = P.combined(days, F.floor(F.col("window") / 7))
    top = {(r.window, r.rank): (r.item, r["count"]) for r in P.top_items(weeks, 3).collect()}
    exact = df.groupBy(F.floor(F.col("day") / 7).alias("w"), "item").count().orderBy("w", F.desc("count"), "item").collect()
    for w in (0, 1):
        assert [top[w, i] for i in (1, 2, 3)] == [(r.item, r["count"]) for r in exact if r.w == w][:3]
    values = {w: sorted(r.v for r in df.filter(F.floor(F.col("day") / 7) == w).select("v").collect()) for w in (0, 1)}
    for r in P.quantiles(weeks, (0.01, 0.5, 0.99)).collect():
        true = sum(v <= r.value for v in values[r.window]) / len(values[r.window])
        assert abs(true - r["rank"]) <= r.error + 1e-3


def test_trends_between_windows(spark):
    rows = [(1, "a")] * 3 + [(1, "b")] + [(2, "b")] * 4 + [(3, "c"), (3, None)]
    s = P.sketches(spark.createDataFrame(rows, "w int, item string"), F.col("w"), F.col("item"), F.lit(1.0))
    t = {(r.window, r.item): (r.share, r.change) for r in P.trends(P.top_items(s, 2), s).collect()}
    assert t == {(1, "a"): (0.75, None), (1, "b"): (0.25, None), (2, "b"): (1.0, 0.75), (3, "c"): (0.5, 0.5)}


def test_counts_are_exact_with_more_items_than_a_sketch_tracks(spark):
    df = spark.range(12_000).select((F.col("id") % 14).alias("day"), F.when(F.col("id") % 50 == 0, "often").otherwise(F.concat(F.lit("m"), F.pmod(F.xxhash64("id"), F.lit(4000)).cast("string"))).alias("item"))
    df = df.unionByName(spark.createDataFrame([(3, None), (9, "m1")] * 2, "day bigint, item string"))
    weeks = P.recounted(P.counted(df, F.col("day"), F.col("item")), F.floor(F.col("window") / 7))
    exact = df.groupBy(F.floor(F.col("day") / 7).alias("w"), "item").count().orderBy("w", F.desc("count"), "item").collect()
    top = P.most_frequent(weeks, 5)
    for w in (0, 1):
        assert [(r.item, r["count"]) for r in top.filter(F.col("window") == w).orderBy("rank").collect()] == [(r.item, r["count"]) for r in exact if r.w == w and r.item is not None][:5]
    assert {(r.window, r.n) for r in P.totals(weeks).collect()} == {(w, sum(r["count"] for r in exact if r.w == w)) for w in (0, 1)}
    assert P.trends(top, P.totals(weeks)).count() == 10

"""Failure patterns of a fleet: mergeable frequency and quantile sketches by time window, and trends between windows.

A window's sketches are a few kilobytes whatever it holds, so they are kept and combined (hours to days, sites to a fleet) without
going back to the rows. Each result says how wrong it can be. Where items may be more than a sketch tracks and counts must be
exact, `counted` keeps a row an item instead; these combine in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The normalised rank error of a KLL sketch of the default size (k = 200), double-sided, at 99 per cent confidence.
RANK_ERROR = 0.0165


def sketches(df: DataFrame, window: Column, item: Column, value: Column, *, tracked: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a window (and `by`): n rows, `top` (frequencies of items) and `spread` (quantiles of values). Null items and values are left
    out of their sketch. tracked: how many items a sketch follows; as long as there are no more, counts are exact."""
    x = df.select(*by, window.alias("window"), item.cast("string").alias("_item"), value.cast("double").alias("_value"))
    top = F.call_function("approx_top_k_accumulate", "_item", F.lit(tracked))
    return x.groupBy(*by, "window").agg(F.count("*").alias("n"), top.alias("top"), F.kll_sketch_agg_double("_value").alias("spread"))


def combined(parts: DataFrame, window: Column, *, tracked: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of wider windows from those of narrower ones."""
    x = parts.withColumn("window", window)
    return x.groupBy(*by, "window").agg(F.sum("n").alias("n"), F.call_function("approx_top_k_combine", "top", F.lit(tracked)).alias("top"), F.kll_merge_agg_double("spread").alias("spread"))


def counted(df: DataFrame, window: Column, item: Column, *, by: tuple[str, ...] = ()) -> DataFrame:
    """window, item, count: exact counts, however many items there are. Rows without an item are counted under null."""
    x = df.select(*by, window.alias("window"), item.cast("string").alias("item"))
    return x.groupBy(*by, "window", "item").agg(F.count("*").alias("count"))


def recounted(parts: DataFrame, window: Column, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact counts of wider windows from those of narrower ones."""
    return parts.withColumn("window", window).groupBy(*by, "window", "item").agg(F.sum("count").alias("count"))


def totals(parts: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """window, n: the rows of each window, from its exact counts."""
    return parts.groupBy(*by, "window").agg(F.sum("count").alias("n"))


def most_frequent(parts: DataFrame, k: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """As `top_items`, from exact counts."""
    w = W.partitionBy(*by, "window").orderBy(F.desc("count"), "item")
    x = parts.filter("item is not null").withColumn("rank", F.row_number().over(w))
    return x.filter(F.col("rank") <= k).select(*by, "window", "rank", "item", "count")


def top_items(parts: DataFrame, k: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """window, rank, item, count: the k most frequent items of each window; ties by item among those that the sketch gives.

    Twice as many are asked for, so that ties at the end are cut by item and not at random."""
    most = F.call_function("approx_top_k_estimate", "top", F.lit(2 * k + 10))
    x = parts.select(*by, "window", F.explode(most).alias("e")).select(*by, "window", "e.item", "e.count").filter("item is not null")
    w = W.partitionBy(*by, "window").orderBy(F.desc("count"), "item")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*by, "window", "rank", "item", "count")


def quantiles(parts: DataFrame, ranks: tuple[float, ...], *, by: tuple[str, ...] = ()) -> DataFrame:
    """window, rank, value, error: values at ranks from 0 to 1, and by how much their true rank may differ."""
    at = F.kll_sketch_get_quantile_double("spread", F.array(*(F.lit(r) for r in ranks)))
    pairs = F.explode(F.arrays_zip(F.array(*(F.lit(r) for r in ranks)).alias("rank"), at.alias("value")))
    return parts.select(*by, "window", pairs.alias("p")).select(*by, "window", "p.rank", "p.value", F.lit(RANK_ERROR).alias("error"))


def trends(top: DataFrame, totals: DataFrame, order: str = "window", *, by: tuple[str, ...] = ()) -> DataFrame:
    """top with `share` of the window's rows and `change` of it since the window before (in which an item that wasn't among the first
    has share 0); null in the first window."""
    known = totals.select(*by, order, "n").distinct()
    shares = top.join(known, [*by, order]).withColumn("share", F.col("count") / F.col("n"))
    line = W.partitionBy(*by).orderBy(order)  # one row a window
    before = known.select(*by, order, F.lag(order).over(line).alias("_before"))
    past = shares.select(*by, F.col(order).alias("_before"), "item", F.col("share").alias("_past"))
    x = shares.join(before, [*by, order]).join(past, [*by, "_before", "item"], "left")
    return x.withColumn("change", F.when(F.col("_before").isNotNull(), F.col("share") - F.coalesce("_past", F.lit(0.0)))).drop("_before", "_past")

"""Order along a key: as-of joins, and running sums that start again at a limit.

Long keys are split. A key's line (time, or a running sum) is cut to slices of a stated width, each of them a window of its own;
what the slices before hand over is one row a slice. So no task holds a whole key, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.sinks import kept


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, *, width: int, order: str | None = None, within: int | None = None, forward: bool = False) -> DataFrame:
    """left with `value` of the nearest row of right with the same `by` and an `at` that isn't later (forward: isn't earlier); null
    where there is none, or none so near as `within`. Left rows with a null `at` or key find nothing.

    by and at are columns of both sides, at a whole number; `value` is a column of right only. Of right rows at one place that with
    the largest `order` counts (forward: the smallest), by default the value itself. width: of a slice, in units of at."""
    rest = [c for c in left.columns if c not in (*by, at)]
    place = F.col(at).cast("bigint") * (-1 if forward else 1)
    pick = F.min_by if forward else F.max_by
    one = right.filter(F.col(at).isNotNull()).dropna(subset=by).groupBy(*by, place.alias("_at")).agg(pick(value, order or value).alias("_v"))
    asked = left.select(*by, place.alias("_at"), F.struct(F.col(at).alias("_own"), *rest).alias("_l"))
    hit = F.struct(F.col("_at").alias("at"), F.col("_v").alias("v")).alias("_hit")
    known = one.select(*by, "_at", F.lit(None).cast(asked.schema["_l"].dataType).alias("_l"), hit)
    lines = asked.withColumn("_hit", F.lit(None).cast(known.schema["_hit"].dataType)).unionByName(known).withColumn("_slice", F.floor(F.col("_at") / width))
    inside = W.partitionBy(*by, "_slice").orderBy("_at", F.col("_l").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = lines.withColumn("_hit", F.last("_hit", ignorenulls=True).over(inside)).filter("_l is not null")
    # One row a slice: the last row that it hands on, null if it only asks.
    handed = lines.groupBy(*by, "_slice").agg(F.max("_hit").alias("_hit"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    handed = handed.select(*by, "_slice", F.last("_hit", ignorenulls=True).over(before).alias("_carry"))
    out = near.join(handed, [*by, "_slice"], "left").withColumn("_best", F.coalesce("_hit", "_carry"))
    ok = F.lit(True) if within is None else F.col("_at") - F.col("_best.at") <= within
    found = out.select(*by, F.col("_l._own").alias(at), *(F.col(f"_l.{c}").alias(c) for c in rest), F.when(ok, F.col("_best.v")).alias(value))
    return found.select(*left.columns, value)


def running_sums(df: DataFrame, by: list[str], order: str, amount: str, *, width: int) -> DataFrame:
    """df with `running`: the sum of amount over a key's rows up to this one, by slices of `order` (a whole number, unique in a key)."""
    x = df.withColumn("_slice", F.floor(F.col(order) / width))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sums = x.groupBy(*by, "_slice").agg(F.sum(amount).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*by, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return x.withColumn("_own", F.sum(amount).over(inside)).join(sums, [*by, "_slice"]).withColumn("running", F.col("_own") + F.col("_before")).drop("_slice", "_own", "_before")


def resets(df: DataFrame, by: list[str], order: str, amount: str, limit: int, *, width: int) -> DataFrame:
    """by, nth, order, used: the rows at which a key's sum of amounts since its last such row reaches the limit (1 or more), counted
    from 1; the sum starts again at 0 there. Amounts are whole numbers; those that are null or not above 0 count as 0. order is a whole
    number, unique in a key; rows with a null key or order are left out.

    The fold depends on the order of all rows, but its steps don't depend on each other: wherever a sum starts, the row that
    ends it is the first whose running sum is larger by the limit, an as-of join on the line of running sums. Which of
    these steps are taken from the key's beginning is found by doubling: after n rounds the first 2^n ends are known."""
    x = df.select(*by, F.col(order).cast("bigint").alias("_pos"), F.col(amount).cast("bigint").alias("_amount")).dropna().filter("_amount > 0")
    sums = kept(running_sums(x, by, "_pos", "_amount", width=width).select(*by, "_pos", F.col("running").alias("_line")))
    # A sum starts before a key's first row, or after a row at which one ended.
    begin = sums.select(*by).distinct().withColumn("_from", F.lit(-(1 << 62)))
    starts = begin.withColumn("_line", F.lit(limit).cast("bigint")).unionByName(sums.select(*by, F.col("_pos").alias("_from"), (F.col("_line") + limit).alias("_line")))
    ends = sums.select(*by, "_line", F.col("_pos").alias("_to"))
    step = kept(as_of(starts, ends, by, "_line", "_to", width=1000 * limit, forward=True).filter("_to is not null").select(*by, "_from", "_to"))
    taken = kept(begin.select(*by, F.col("_from").alias("_at"), F.lit(0).cast("bigint").alias("nth")))
    jump, n = step, 1
    while True:
        more = kept(taken.join(jump.withColumnRenamed("_from", "_at"), [*by, "_at"]).select(*by, F.col("_to").alias("_at"), (F.col("nth") + n).alias("nth")))
        if more.isEmpty():
            break
        taken = kept(taken.unionByName(more))
        jump = kept(jump.join(jump.select(*by, F.col("_from").alias("_to"), F.col("_to").alias("_next")), [*by, "_to"]).select(*by, "_from", F.col("_next").alias("_to")))
        n *= 2
    met = taken.filter("nth > 0").join(sums.withColumnRenamed("_pos", "_at"), [*by, "_at"])
    used = F.col("_line") - F.coalesce(F.lag("_line").over(W.partitionBy(*by).orderBy("nth")), F.lit(0))
    return met.withColumn("used", used).select(*by, "nth", F.col("_at").alias(order), "used")


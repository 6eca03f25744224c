"""Scorecards: conditional counts per group, health scores, flags, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import ACTIVE, consumers

PENDING, INACTIVE = ("draft", "submitted", "needs_revision"), ("deprecated", "retired")


def days_since(date: Column, as_of: Column) -> Column:
    """Whole days since an ISO date; null where it isn't one."""
    return F.datediff(as_of, F.try_to_timestamp(F.substring(date, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def health_score(n: Column, deprecated_pct: Column, stale: Column, failing: Column, blocked: Column, security: Column, approved: Column) -> Column:
    """Bundle score of 0 to 100, half-even."""
    raw = 100 - 0.5 * deprecated_pct - F.least(stale / n * 40, F.lit(30)) - 10 * failing - 15 * blocked - 5 * security + approved / n * 10
    return F.when(n > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 0).cast("int")).otherwise(F.lit(0))


def platform_score(n: Column, deprecated: Column, stale: Column, failing: Column, blocked: Column, approved: Column) -> Column:
    """The other score, over all assets at once."""
    raw = 100 - F.least(deprecated / n * 50, F.lit(20)) - F.least(stale / n * 40, F.lit(25)) - 10 * failing - 5 * blocked + approved / n * 5
    return F.when(n > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 0).cast("int")).otherwise(F.lit(0))


def flag(score: Column, deprecated_pct: Column, stale_pct: Column, text_compare: bool = False) -> Column:
    """HIGH, WARNING or OK; text_compare orders percentages as texts, as an older report did."""
    over = (lambda c, t: F.concat(c.cast("int").cast("string"), F.lit("%")) >= F.lit(f"{t}%")) if text_compare else (lambda c, t: c >= t)
    return F.when((score < 40) | over(deprecated_pct, 30), "HIGH").when((score < 70) | over(stale_pct, 30), "WARNING").otherwise("OK")


def icon(score: Column) -> Column:
    return F.when(score >= 70, "🟢").when(score >= 40, "🟡").otherwise("🔴")


def bundle_dashboard(skills: DataFrame, tools: DataFrame, ci: DataFrame, as_of: Column, stale_days: int = 180) -> DataFrame:
    """Figures per bundle. Skills never reviewed count as stale; ci: asset_name, overall."""
    s = skills.join(ci.select(F.col("asset_name").alias("skill_name"), "overall"), "skill_name", "left")
    status = F.col("status")
    stale = F.coalesce(days_since(F.col("last_reviewed"), as_of), F.lit(99_999)) > stale_days
    g = s.groupBy("bundle_scope").agg(
        F.count("*").alias("n"), F.count_if(status.isin(*ACTIVE)).alias("n_active"), F.count_if(status == "approved").alias("n_approved"), F.count_if(status == "restricted").alias("n_restricted"),
        F.count_if(status.isin(*PENDING)).alias("n_pending"), F.count_if(status == "deprecated").alias("n_deprecated"), F.count_if(status == "retired").alias("n_retired"),
        F.count_if(F.col("risk_level").isin("L3", "L4")).alias("n_high_risk"), F.count_if(F.col("eval_status") == "pending").alias("eval_pending"),
        F.count_if(F.col("eval_status") == "failing").alias("eval_failing"), F.count_if((F.col("risk_level") == "L4") & (F.col("security_review") == "pending")).alias("security_pending"),
        F.count_if(status.isin(*ACTIVE) & stale).alias("n_stale"), F.count_if(F.col("overall") == "PASS").alias("ci_pass"), F.count_if(F.col("overall") == "WARNING").alias("ci_warn"),
        F.count_if(F.col("overall") == "BLOCKED").alias("ci_blocked"), F.count("overall").alias("ci_covered"),
    )
    used = consumers(skills, tools).filter("bundle_scope is not null").groupBy("bundle_scope").agg(F.count_distinct("tool_name").alias("n_tools"))
    x = g.join(used, "bundle_scope", "left").withColumn("n_tools", F.coalesce("n_tools", F.lit(0)))
    x = x.withColumn("ratio", X.ratio_text(F.col("n"), F.col("n_tools"))).withColumn("deprecated_pct", F.bround((F.col("n_deprecated") + F.col("n_retired")) / F.col("n") * 100, 0)).withColumn("stale_pct", F.bround(F.col("n_stale") / F.col("n") * 100, 0))
    x = x.withColumn("score", health_score(F.col("n"), F.col("deprecated_pct"), F.col("n_stale"), F.col("eval_failing"), F.col("ci_blocked"), F.col("security_pending"), F.col("n_approved")))
    return x.withColumn("flag", flag(F.col("score"), F.col("deprecated_pct"), F.col("stale_pct"))).withColumn("backlog", F.col("n_pending") + F.col("eval_pending"))


def platform_rollup(dashboard: DataFrame) -> DataFrame:
    return dashboard.agg(
        F.sum("n").alias("n"), F.sum("n_active").alias("n_active"), F.bround(F.avg("score"), 0).cast("int").alias("mean_score"),
        *(F.sort_array(F.collect_list(F.when(F.col("flag") == f, F.col("bundle_scope")))).alias(f.lower()) for f in ("HIGH", "WARNING", "OK")),
    )


RESULTS = ("PASS", "PASS_WITH_WARNINGS", "WARNING", "REQUIRES_REVIEW", "REJECT")


def worst_of(results: DataFrame, key: str, result: str = "result", lenient: bool = False) -> DataFrame:
    """The worst result of each key; an unknown one is a rejection (or, leniently, a pass)."""
    order = F.array(*(F.lit(r) for r in RESULTS))
    rank = F.array_position(order, F.col(result))
    rank = F.when(rank == 0, F.lit(1 if lenient else len(RESULTS))).otherwise(rank)
    return results.groupBy(key).agg(F.max(rank).cast("int").alias("_r"), F.count("*").alias("n_checks")).select(key, "n_checks", F.get(order, F.col("_r") - 1).alias("overall"))


def batch_gate(decisions: DataFrame, group: str) -> DataFrame:
    d = F.col("overall")
    g = decisions.groupBy(group).agg(F.count("*").alias("n"), F.count_if(d == "PASS").alias("n_pass"), F.count_if(d.isin("WARNING", "PASS_WITH_WARNINGS")).alias("n_warn"), F.count_if(d.isin("REJECT", "REQUIRES_REVIEW")).alias("n_blocked"))
    return g.withColumn("ready_pct", F.bround((F.col("n_pass") + F.col("n_warn")) / F.col("n") * 100, 0))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, by asset type and by code, in one pass; severities without findings have 0."""
    g = findings.groupingSets([["severity"], ["asset_type"], ["code"]], "severity", "asset_type", "code").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    out = g.select(F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "asset_type").otherwise("code").alias("by"), F.coalesce("severity", "asset_type", "code").alias("value"), "n")
    zero = findings.sparkSession.createDataFrame([("severity", s) for s in ("CRITICAL", "HIGH", "WARNING")], "by string, value string").join(out, ["by", "value"], "left_anti").withColumn("n", F.lit(0).cast("bigint"))
    return out.unionByName(zero)


def review_queue(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("severity").isin("HIGH", "CRITICAL"))


def family_overload(skills: DataFrame, least: int = 5) -> DataFrame:
    g = skills.groupBy("bundle_scope", F.substring_index("skill_name", "-", 1).alias("family")).agg(F.count("*").alias("n"))
    return g.filter(F.col("n") >= least)


def at_least(conditions: list[Column], k: int) -> Column:
    """k of n conditions hold; unknown ones don't."""
    return F.size(F.filter(F.array(*(F.coalesce(c, F.lit(False)) for c in conditions)), lambda c: c)) >= k

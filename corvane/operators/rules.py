"""Rule catalogue: each rule is a query that emits findings (asset_type, asset_name, code, severity, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import ACTIVE, consumers, risk_rank
from .scorecard import INACTIVE, PENDING, days_since, family_overload
from .similarity import jaccard_pairs

#: Fixed values of the catalogue.
STATUSES = ("draft", "submitted", "approved", "restricted", "needs_revision", "deprecated", "retired")
SCOPES = ("diagnosis-agent", "customer-agent", "ops-agent", "energy-agent", "bpmn-agent", "platform")
CATEGORIES = ("parsing", "transformation", "validation", "execution", "retrieval", "computation")
SIDE_EFFECTS = {"L0": "none", "L1": "read", "L2": "read", "L3": "write", "L4": "external"}
NAME = "^[a-z][a-z0-9-]{1,62}[a-z0-9]$"
TOOL_NAME = "^[a-z][a-z0-9-]{1,46}[a-z0-9]$"
VAGUE = ("manages", "handles", "general", "various", "deals with", "helps with", "provides support", "works with")
VAGUE_ROUTING = ("manages", "handles", "general", "various", "deals with", "helps with", "provides", "supports")
SKILL_FIELDS = ("skill_name", "owner_team", "version", "status", "risk_level", "bundle_scope", "eval_status")
TOOL_FIELDS = ("tool_name", "category", "risk_level", "side_effects", "owner_team", "service", "status")
WRITE_VERBS = ("creat", "dispatch", "send", "update", "modify", "delete", "generat", "submit", "assign", "schedule", "publish")
CONTROL_VERBS = ("restart", "reboot", "stop charging", "disable", "unlock", "power limit", "control device", "set power", "force stop")
DOMAINS = {
    "diagnosis-agent": ("fault", "diagnos", "hardware", "log", "charger", "error", "repair"),
    "customer-agent": ("customer", "billing", "session", "account", "user", "vehicle", "compatibility"),
    "ops-agent": ("fleet", "capacity", "energy", "maintenance", "knowledge", "rag", "index", "embed"),
    "energy-agent": ("energy", "consumption", "optimization", "power", "grid", "load"),
    "bpmn-agent": ("bpmn", "process", "workflow", "diagram", "entity", "intent", "xml"),
}
INLINE_CALL = r"\b[\w][\w-]+:([\w][\w_]+)\("
NON_ATOMIC = ("manager", "handler", "coordinator", "orchestrator", "controller", "processor", "dispatcher", "supervisor")
TRIGGER_RISK = {"资金": "L3", "转账": "L4", "放款": "L4", "扣款": "L4", "开卡": "L4", "销户": "L4", "征信报送": "L5", "反洗钱": "L2", "跨境": "L5", "监管报送": "L5"}
CLASS_RISK = {
    "public": ("allow",) * 6,
    "internal": ("allow",) * 3 + ("warn",) * 3,
    "confidential": ("allow", "allow", "warn", "mask", "mask", "mask"),
    "secret": ("allow", "allow", "approve", "approve+mask", "approve+mask", "approve+mask"),
}
RETENTION_YEARS = {"public": 1, "internal": 3, "confidential": 5, "secret": 15}


def finding(df: DataFrame, kind: str, name: str, code: str, severity: str | Column, message: Column | str) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(F.lit(kind).alias("asset_type"), F.col(name).alias("asset_name"), F.lit(code).alias("code"), lit(severity).alias("severity"), lit(message).alias("message"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _missing(df: DataFrame, fields: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(f)), F.lit("")) == "", F.lit(f)) for f in fields)))


def state_guard(skills: DataFrame, tools: DataFrame) -> DataFrame:
    """Lifecycle states against each other; a row of invalid status is reported for that alone."""
    bad = skills.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))
    ok = skills.filter(F.col("status").isin(*STATUSES))
    active = ok.filter(F.col("status").isin(*ACTIVE))
    deps = active.select("skill_name", F.explode("dependencies").alias("dep")).join(skills.select(F.col("skill_name").alias("dep"), F.col("status").alias("dep_status")), "dep", "left")
    d = F.col("dep_status")
    uses = consumers(skills, tools.filter(F.col("status").isin(*STATUSES))).filter("consumer is not null")
    known, st = F.col("skill_status").isNotNull(), F.col("skill_status")
    off = uses.filter(F.col("tool_status").isin(*INACTIVE) & st.isin(*ACTIVE)).select("tool_name", "tool_status").distinct()
    return union(
        finding(bad, "skill", "skill_name", "S-STATE-1", "CRITICAL", F.concat(F.lit("invalid status "), F.coalesce("status", F.lit("")))),
        finding(active.filter((F.col("risk_level") == "L4") & ~F.col("security_review").eqNullSafe(F.lit("approved"))), "skill", "skill_name", "S-STATE-2", "HIGH", "L4 without an approved security review"),
        finding(deps.filter(d.isin(*PENDING)), "skill", "skill_name", "S-STATE-3", "CRITICAL", F.concat(F.lit("depends on pending "), F.col("dep"))),
        finding(deps.filter(d.isin(*INACTIVE)), "skill", "skill_name", "S-STATE-4", F.when(d == "retired", "CRITICAL").otherwise("HIGH"), F.concat(F.lit("depends on "), d, F.lit(" "), F.col("dep"))),
        finding(deps.filter(d.isNull()), "skill", "skill_name", "S-STATE-5", "HIGH", F.concat(F.lit("depends on missing "), F.col("dep"))),
        finding(tools.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), "tool", "tool_name", "T-STATE-1", "CRITICAL", "invalid status"),
        finding(uses.filter(st == "retired"), "tool", "tool_name", "T-STATE-2", "WARNING", F.concat(F.lit("retired consumer "), F.col("consumer"))),
        finding(uses.filter(~known & ~F.lower("consumer").isin("pending", "tbd", "")), "tool", "tool_name", "T-STATE-3", "WARNING", F.concat(F.lit("unknown consumer "), F.col("consumer"))),
        finding(off, "tool", "tool_name", "T-STATE-4", F.when(F.col("tool_status") == "retired", "CRITICAL").otherwise("HIGH"), "inactive tool has active consumers"),
    )


def guard_result(findings: DataFrame) -> DataFrame:
    worst = F.max(F.when(F.col("severity").isin("CRITICAL", "HIGH"), 2).otherwise(1))
    return findings.agg(F.coalesce(worst, F.lit(0)).alias("w")).select(F.when(F.col("w") == 2, "FAIL").when(F.col("w") == 1, "WARN").otherwise("PASS").alias("result"))


def alignment(registry: DataFrame, found: DataFrame, kind: str, name: str, attributes: list[str]) -> DataFrame:
    """S1/T1: registered but not found, found but not registered, and attributes that differ."""
    both = registry.join(found.select(name, *(F.col(a).alias(f"_{a}") for a in attributes)), name)
    drift = F.array_compact(F.array(*(F.when(F.coalesce(F.col(a), F.lit("")) != F.coalesce(F.col(f"_{a}"), F.lit("")), F.lit(a)) for a in attributes)))
    return union(
        finding(registry.join(found.select(name), name, "left_anti"), kind, name, "missing_in_fs", "HIGH", "registered, but there is no file"),
        finding(found.join(registry.select(name), name, "left_anti"), kind, name, "missing_in_registry", "WARNING", "there is a file, but no entry"),
        finding(both.withColumn("_d", drift).filter(F.size("_d") > 0), kind, name, "metadata_drift", "WARNING", F.array_join("_d", ",")),
    )


def skill_metadata(skills: DataFrame, as_of: Column) -> DataFrame:
    """S2."""
    age = F.coalesce(days_since(F.col("created_at"), as_of), F.lit(0))
    vague = X.hits(F.col("purpose"), VAGUE)
    x = skills.withColumn("_m", _missing(skills, SKILL_FIELDS)).withColumn("_v", vague)
    known = lambda c, values: ~F.col(c).isin(*values) & (F.coalesce(F.col(c), F.lit("")) != "")
    return union(
        finding(x.filter(F.size("_m") > 0), "skill", "skill_name", "missing_fields", "HIGH", F.array_join("_m", ",")),
        finding(x.filter((F.length(F.coalesce("purpose", F.lit(""))) < 20) | (F.size("_v") > 0)), "skill", "skill_name", "description_degraded", "WARNING", F.coalesce(F.get("_v", F.lit(0)), F.lit("too short"))),
        finding(x.filter(~F.col("skill_name").rlike(NAME)), "skill", "skill_name", "naming_violation", "WARNING", "name"),
        finding(x.filter(known("bundle_scope", SCOPES)), "skill", "skill_name", "invalid_scope", "WARNING", F.col("bundle_scope")),
        finding(x.filter(known("status", STATUSES)), "skill", "skill_name", "invalid_status", "WARNING", F.col("status")),
        finding(x.filter((F.col("eval_status") == "pending") & (age > 90)), "skill", "skill_name", "eval_stale", "WARNING", age.cast("string")),
        finding(x.filter(F.col("eval_status") == "failing"), "skill", "skill_name", "eval_failing", "HIGH", "evaluation fails"),
    )


def skill_overlap(skills: DataFrame) -> DataFrame:
    """S3: similar purposes, and families with many members."""
    x = skills.filter(F.col("status").isin("approved", "submitted", "restricted"))
    pairs = jaccard_pairs(x, "skill_name", "purpose", 0.45)
    return union(
        finding(pairs, "skill", "a", "overlap_candidate", F.when(F.col("jaccard") > 0.65, "HIGH").otherwise("WARNING"), F.concat(F.lit("like "), F.col("b"))),
        finding(family_overload(skills), "bundle", "bundle_scope", "family_overload", "WARNING", F.col("family")),
    )


def skill_reviews(skills: DataFrame, as_of: Column) -> DataFrame:
    """S4: retired skills are left out."""
    x = skills.filter(~F.col("status").eqNullSafe(F.lit("retired"))).withColumn("_d", days_since(F.col("last_reviewed"), as_of))
    return union(
        finding(x.filter("_d > 180"), "skill", "skill_name", "review_overdue", "WARNING", F.col("_d").cast("string")),
        finding(x.filter((F.col("risk_level") == "L4") & (F.col("security_review") == "pending") & (F.coalesce("_d", F.lit(31)) > 30)), "skill", "skill_name", "security_review_overdue", "CRITICAL", "security review"),
        finding(x.filter((F.col("eval_status") == "failing") & (F.col("_d") > 90) & (F.col("status") == "approved")), "skill", "skill_name", "deprecated_candidate", "HIGH", "fails for long"),
        finding(x.filter((F.col("status") == "approved") & (F.col("_d") > 365)), "skill", "skill_name", "stale_approved", "WARNING", F.col("_d").cast("string")),
    )


def tool_metadata(tools: DataFrame) -> DataFrame:
    """T2."""
    x = tools.withColumn("_m", _missing(tools, TOOL_FIELDS))
    wanted = F.try_element_at(F.create_map(*(v for k, s in SIDE_EFFECTS.items() for v in (F.lit(k), F.lit(s)))), F.col("risk_level"))
    known = lambda c, values: ~F.col(c).isin(*values) & (F.coalesce(F.col(c), F.lit("")) != "")
    return union(
        finding(x.filter(F.size("_m") > 0), "tool", "tool_name", "missing_fields", "HIGH", F.array_join("_m", ",")),
        finding(x.filter(~F.col("tool_name").rlike(NAME)), "tool", "tool_name", "naming_violation", "WARNING", "name"),
        finding(x.filter(known("category", CATEGORIES)), "tool", "tool_name", "invalid_category", "WARNING", F.col("category")),
        finding(x.filter(known("risk_level", tuple(SIDE_EFFECTS))), "tool", "tool_name", "invalid_risk", "HIGH", F.col("risk_level")),
        finding(x.filter(F.col("side_effects") != wanted), "tool", "tool_name", "risk_mismatch", "HIGH", F.col("side_effects")),
        finding(x.filter(known("status", STATUSES)), "tool", "tool_name", "invalid_status", "WARNING", F.col("status")),
    )


def tool_reviews(tools: DataFrame, as_of: Column) -> DataFrame:
    """T3."""
    x = tools.filter(~F.col("status").eqNullSafe(F.lit("retired"))).withColumn("_d", days_since(F.col("last_reviewed"), as_of))
    return union(
        finding(x.filter("_d > 180"), "tool", "tool_name", "review_overdue", "WARNING", F.col("_d").cast("string")),
        finding(x.filter(F.col("risk_level").isin("L3", "L4") & (F.col("_d") > 60)), "tool", "tool_name", "high_risk_review_overdue", F.when(F.col("risk_level") == "L4", "CRITICAL").otherwise("HIGH"), F.col("_d").cast("string")),
        finding(x.filter((F.col("status") == "approved") & (F.col("_d") > 365)), "tool", "tool_name", "stale_approved", "WARNING", F.col("_d").cast("string")),
    )


def tool_consumers(skills: DataFrame, tools: DataFrame) -> DataFrame:
    """T4: inactive tools are left out."""
    uses = consumers(skills, tools.filter(F.col("status").isin(*ACTIVE)))
    g = uses.groupBy("tool_name").agg(F.count("consumer").alias("n"))
    named = uses.filter("consumer is not null")
    return union(
        finding(g.filter("n = 0"), "tool", "tool_name", "no_consumers", "HIGH", "nobody calls it"),
        finding(g.filter("n = 1"), "tool", "tool_name", "single_consumer", "WARNING", "one caller"),
        finding(named.filter("skill_status is null"), "tool", "tool_name", "unknown_consumer", "HIGH", F.col("consumer")),
        finding(named.filter("skill_status = 'deprecated'"), "tool", "tool_name", "deprecated_consumer", "WARNING", F.col("consumer")),
    )


def inline_tool_calls(bodies: DataFrame, tools: DataFrame) -> DataFrame:
    """X1 and X2: calls in skill texts to unknown or inactive tools; meta-skills are exempt from X1."""
    calls = bodies.select("skill_name", "meta_skill", F.explode(F.regexp_extract_all("body", F.lit(INLINE_CALL), F.lit(1))).alias("call")).distinct()
    x = calls.join(tools.select(F.translate("tool_name", "-", "_").alias("call"), F.col("status").alias("tool_status")), "call", "left")
    meta = F.lower(F.coalesce("meta_skill", F.lit(""))).isin("true", "yes", "1")
    return union(
        finding(x.filter(F.col("tool_status").isNull() & ~meta), "skill", "skill_name", "unregistered_call", "HIGH", F.col("call")),
        finding(x.filter(F.col("tool_status").isin(*INACTIVE)), "skill", "skill_name", "inactive_call", "HIGH", F.col("call")),
    )


def risk_inheritance(skills: DataFrame, tools: DataFrame) -> DataFrame:
    """X3: a tool of higher risk than the skill that calls it."""
    x = consumers(skills, tools).filter("skill_status is not null")
    gap = x.filter(risk_rank(F.col("tool_risk"), "L0") > risk_rank(F.col("skill_risk"), "L1"))
    return finding(gap, "skill", "consumer", "risk_inheritance_gap", "HIGH", F.col("tool_name"))


def audit(skills: DataFrame, tools: DataFrame, as_of: Column) -> DataFrame:
    return union(skill_metadata(skills, as_of), skill_overlap(skills), skill_reviews(skills, as_of), tool_metadata(tools), tool_reviews(tools, as_of), tool_consumers(skills, tools), risk_inheritance(skills, tools))


def result_code(score: Column, marks: tuple[int, int, int]) -> Column:
    a, b, c = marks
    return F.when(score >= a, "PASS").when(score >= b, "PASS_WITH_WARNINGS").when(score >= c, "NEEDS_REVISION").otherwise("FAIL")


def class_risk(data_class: Column, risk: Column) -> Column:
    """What a data class allows at a risk level."""
    table = F.create_map(*(v for c, row in CLASS_RISK.items() for v in (F.lit(c), F.array(*(F.lit(r) for r in row)))))
    return F.get(F.try_element_at(table, data_class), (risk_rank(risk) - 1).cast("int"))


def keep_until(data_class: Column, day: Column) -> Column:
    years = F.create_map(*(v for c, n in RETENTION_YEARS.items() for v in (F.lit(c), F.lit(n))))
    return F.add_months(day, F.try_element_at(years, data_class) * 12)


def trigger_risk(text: Column) -> Column:
    """The highest risk level that a trigger word asks for; null without one."""
    return F.greatest(*(F.when(F.contains(text, F.lit(w)), F.lit(r)) for w, r in TRIGGER_RISK.items()))


def credit_decision(score: Column, overdue: Column, dti: Column) -> Column:
    return F.when((score < 600) | (overdue > 2) | (dti > 0.5), "review").otherwise("approve")


def regulatory(processes: DataFrame) -> DataFrame:
    """R1 to R6 over processes (name, data_class, customer_data, consent, funds, aml_step, retention, cross_border, approved, credit_decision, rationale)."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = [
        ("R1", "CRITICAL", F.coalesce("data_class", F.lit("")) == "", "no data class"), ("R2", "CRITICAL", yes("customer_data") & ~yes("consent"), "customer data without consent"),
        ("R3", "HIGH", yes("funds") & ~yes("aml_step"), "funds without an AML step"), ("R4", "WARNING", F.col("retention").isNull(), "no retention"),
        ("R5", "CRITICAL", yes("cross_border") & ~yes("approved"), "cross-border without approval"), ("R6", "HIGH", yes("credit_decision") & (F.coalesce("rationale", F.lit("")) == ""), "credit decision without rationale"),
    ]
    return union(*(finding(processes.filter(c), "process", "name", code, sev, msg) for code, sev, c, msg in rows))

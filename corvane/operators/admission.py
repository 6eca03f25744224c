"""Admission gates: five checks of each candidate against a registry, the decision, its reasons and neighbours.

A candidate never meets its own registry entry (that of the same name). Every check gives a result; the
decision is the worst. Comparisons are joins over shared words and name pieces, for all candidates at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .rules import CATEGORIES, CONTROL_VERBS, DOMAINS, NON_ATOMIC, SCOPES, SIDE_EFFECTS, VAGUE_ROUTING, WRITE_VERBS
from .similarity import jaccard_between, near_names
from .validators import TRIGGERS

#: Fixed values of the gates.
SERVICES = ("bpmn-tools", "diagnosis-tools", "customer-tools", "ops-tools", "energy-tools")
SKILL_CALLS = (r"use\s+the\s+\S+-skill", r"call\s+the\s+\S+-skill", r"invoke\s+\S+-skill", r"trigger\s+\S+-skill")
BROAD = ("all", "any", "everything", "whenever", "always", "any request")
CONJUNCTIONS = ("and also", "as well as", "additionally", "furthermore", "moreover")
APPROVAL = "verify-gate-mcp:request_approval"
SECTION = r"(?s)# {}(.*?)(?=\n#|\z)"
WORKFLOW = r"(?s)# Workflow(.*?)(?=\n#[^#]|\z)"
STEP = r"\[\s*\]\s*Step\s*\d+"
ERROR_PATH = r"(?i)error|fail|not found|exception|if .* → |else"
ORCHESTRATION = ("orchestrat", "coordinat", "manag", "sequenc", "pipeline", "first.*then.*finally", "step 1", "step 2", "multi-step", "workflow", "call.*tool", "invoke.*skill")
FOREIGN_WORDS, SHORT_DESCRIPTION, LONG_DESCRIPTION = 5, 40, 250
SKILL_REVIEW, SKILL_WARN, TOOL_REVIEW, FIELD_REVIEW, ELSEWHERE_REVIEW = 0.65, 0.45, 0.65, 0.70, 0.55

LEVELS = ("PASS", "WARNING", "REQUIRES_REVIEW", "REJECT")
DECISIONS = ("PASS", "PASS_WITH_WARNINGS", "REQUIRES_REVIEW", "REJECT")

#: What a check finds: a code, the level it asks for, and its condition.
Finding = tuple[str, str, Column]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _any_hit(text: Column, words: tuple[str, ...]) -> Column:
    return F.size(X.hits(text, words)) > 0


def _patterns(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (text.rlike("(?d)" + p).cast("int") for p in patterns))


def _decided(df: DataFrame, names: tuple[str, ...], checks: dict[str, list[Finding]]) -> DataFrame:
    """The names, a column per check, decision, reasons (codes in the order of the checks) and neighbours."""
    rank = {level: F.lit(k) for k, level in enumerate(LEVELS)}
    yes = lambda c: F.coalesce(c, F.lit(False))
    worst = {check: F.greatest(F.lit(0), *(F.when(yes(c), rank[level]).otherwise(F.lit(0)) for _, level, c in found)) for check, found in checks.items()}
    named = lambda names, k: F.element_at(F.array(*(F.lit(n) for n in names)), k + 1)
    reasons = F.array_compact(F.array(*(F.when(yes(c), F.lit(code)) for found in checks.values() for code, _, c in found)))
    return df.select(
        *names, *(named(LEVELS, k).alias(check) for check, k in worst.items()), named(DECISIONS, F.greatest(*worst.values())).alias("decision"),
        reasons.alias("reasons"), F.array_sort(F.coalesce("neighbours", F.array().cast("array<string>"))).alias("neighbours"),
    )


def _section(body: Column, title: str) -> Column:
    """Text of a section up to the next heading of any depth."""
    return F.lower(F.regexp_extract(body, SECTION.format(title), 1))


def _who(*columns: str) -> Column:
    """One value for all that a row is compared by."""
    return F.md5(F.to_json(F.struct(*columns)))


def check_rows(decided: DataFrame, name: str) -> DataFrame:
    """(name, check, result): a row per check of a gate's decisions."""
    after = decided.columns.index(name) + 1
    checks = decided.columns[after : decided.columns.index("decision")]
    return decided.select(F.col(name).alias("name"), F.inline(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("result")) for c in checks))))


def skill_gate(candidates: DataFrame, registry: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decisions on skill documents (name, description, body, bundle_scope, risk_level) against skill_name, purpose.

    A row per document, repeated names too; `keep` names columns that stay. Nulls count as empty names and texts, a null risk as L1.
    """
    x = candidates.select(*keep, _text("name").alias("name"), _text("description").alias("description"), _text("body").alias("body"), _text("bundle_scope").alias("scope"), F.upper(F.coalesce("risk_level", F.lit("L1"))).alias("risk"))
    x = x.withColumn("who", _who("name", "description"))
    entries = registry.select("skill_name", _text("purpose").alias("purpose")).filter("skill_name is not null")
    names = x.select("who", "name").distinct()
    near = near_names(x.select(F.col("name").alias("skill_name")), entries, "skill_name", 2)
    near = near.join(names, F.col("candidate") == F.col("name")).select("who", F.col("existing").alias("b"), F.lit(True).alias("near"), F.lit(None).cast("double").alias("alike"))
    texts = jaccard_between(x, entries, ("who", "skill_name"), (X.word_tokens(F.col("description")), X.word_tokens(F.col("purpose"))), SKILL_WARN).withColumnRenamed("a", "who")
    texts = texts.join(names, "who").filter((F.col("jaccard") > SKILL_WARN) & (F.col("b") != F.col("name"))).select("who", "b", F.lit(False).alias("near"), F.col("jaccard").alias("alike"))
    met = near.unionByName(texts).groupBy("who").agg(F.max("near").alias("near"), F.max("alike").alias("alike"), F.collect_set("b").alias("neighbours"))
    x = x.join(met, "who", "left")

    low, flow = F.lower("description"), F.lower(F.regexp_extract("body", WORKFLOW, 1))
    operative = F.concat_ws(" ", low, *(_section(F.col("body"), s) for s in ("Workflow", "Purpose", "Trigger")))
    foreign = reduce(lambda a, b: a + b, ((F.size(X.hits(operative, w)) >= FOREIGN_WORDS).cast("int") * (F.col("scope") != scope).cast("int") for scope, w in DOMAINS.items()))
    known = F.col("scope").isin(*SCOPES)
    control, l4 = _any_hit(flow, CONTROL_VERBS), F.col("risk") == "L4"
    calls = _patterns(F.lower("body"), SKILL_CALLS) > 0
    steps = F.size(F.regexp_extract_all("body", F.lit(STEP), F.lit(0)))
    return _decided(x, (*keep, "name"), {
        "global_conflict": [("near_name", "WARNING", F.col("near")), ("description_overlap", "REQUIRES_REVIEW", F.col("alike") > SKILL_REVIEW), ("description_near", "WARNING", F.col("alike") <= SKILL_REVIEW)],
        "agent_boundary": [("scope_missing", "REJECT", F.col("scope") == ""), ("scope_unknown", "REJECT", (F.col("scope") != "") & ~known), ("mixed_domains", "REQUIRES_REVIEW", known & (foreign >= 2)), ("foreign_domain", "WARNING", known & (foreign == 1))],
        "risk_level": [
            ("control_below_l4", "REJECT", control & ~l4), ("l4_without_approval", "REJECT", control & l4 & ~F.col("body").contains(APPROVAL)),
            ("write_at_l1", "REQUIRES_REVIEW", ~control & (F.col("risk") == "L1") & _any_hit(F.concat_ws(" ", flow, low), WRITE_VERBS)), ("l4_without_control", "WARNING", l4 & ~control),
        ],
        "routing_governance": [
            ("short_description", "WARNING", F.length(F.regexp_replace("description", r"^\s+|\s+$", "")) < SHORT_DESCRIPTION), ("no_trigger", "WARNING", ~_any_hit(low, TRIGGERS)),
            ("vague_words", "WARNING", _any_hit(low, VAGUE_ROUTING)), ("too_broad", "REQUIRES_REVIEW", F.size(X.hits(low, BROAD)) >= 2),
        ],
        "form_factor": [("calls_skills", "REJECT", calls), ("few_steps", "WARNING", ~calls & (steps <= 2) & ~F.col("body").rlike(ERROR_PATH)), ("conjunctions", "REQUIRES_REVIEW", ~calls & _any_hit(low, CONJUNCTIONS))],
    })


def tool_candidates(documents: DataFrame) -> DataFrame:
    """What tool_gate judges, from tool documents with nested keys; a usage block, even without callers, outranks the top key."""
    callers = F.when(F.col("usage").isNotNull(), F.col("usage.called_by_skills")).otherwise(F.col("called_by_skills"))
    return documents.select(
        "tool_name", "description", "category", F.coalesce(F.nullif("service", F.lit("")), "ownership.service").alias("service"), F.col("risk.level").alias("risk_level"), "risk.side_effects", "risk.idempotent",
        "risk.requires_approval", callers.alias("called_by_skills"), F.map_keys("input_schema.properties").alias("input_fields"),
    )


def tool_gate(candidates: DataFrame, registry: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decisions on tools against a registry of tool_name, display_name, description, service, input_fields.

    Candidates have tool_name, description, category, service, risk_level, side_effects, idempotent,
    requires_approval, called_by_skills and input_fields; a null risk block counts as an unknown level.
    """
    fields = lambda c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))
    x = candidates.select(
        *keep, _text("tool_name").alias("tool_name"), _text("description").alias("description"), F.lower(_text("category")).alias("category"), _text("service").alias("service"), F.upper(_text("risk_level")).alias("risk"),
        F.lower(_text("side_effects")).alias("effects"), "idempotent", "requires_approval", F.filter(F.coalesce("called_by_skills", F.array().cast("array<string>")), lambda s: F.trim(s) != "").alias("callers"), fields("input_fields").alias("fields"),
    )
    entries = registry.select("tool_name", F.coalesce("description", "display_name", F.lit("")).alias("description"), _text("service").alias("service"), fields("input_fields").alias("fields")).filter("tool_name is not null")
    x = x.withColumn("who", _who("tool_name", "description", "service", "fields"))
    names = x.select("who", F.col("tool_name").alias("own"), F.col("service").alias("own_service")).distinct()
    near = near_names(x, entries, "tool_name", 4).join(names, F.col("candidate") == F.col("own")).select("who", F.col("existing").alias("b"), "distance")
    texts = jaccard_between(x, entries, ("who", "tool_name"), (X.word_tokens(F.col("description")),) * 2, ELSEWHERE_REVIEW, keep=("service",))
    shapes = jaccard_between(x, entries, ("who", "tool_name"), (F.col("fields"),) * 2, FIELD_REVIEW).withColumnRenamed("jaccard", "overlap")
    texts, shapes = (d.withColumnRenamed("a", "who").join(names, "who") for d in (texts, shapes))
    other = F.col("b") != F.col("own")
    texts = texts.select("who", "b", F.when(other, F.col("jaccard")).alias("alike"), F.when(F.col("service") != F.col("own_service"), F.col("jaccard")).alias("elsewhere"))
    met = near.unionByName(texts, allowMissingColumns=True).unionByName(shapes.filter(other).select("who", "b", "overlap"), allowMissingColumns=True)
    neighbour = F.when(F.col("distance").isNotNull() | (F.col("alike") >= TOOL_REVIEW), F.col("b"))
    met = met.groupBy("who").agg(F.min("distance").alias("distance"), *(F.max(c).alias(c) for c in ("alike", "elsewhere", "overlap")), F.collect_set(neighbour).alias("neighbours"))
    x = x.join(met, "who", "left")

    wanted = F.try_element_at(F.create_map(*(F.lit(v) for pair in SIDE_EFFECTS.items() for v in pair)), F.col("risk"))
    approved = F.coalesce(F.col("requires_approval"), F.lit(False))
    high = F.col("risk").isin("L3", "L4")
    name = F.lower("tool_name")
    part = reduce(Column.__or__, (name.endswith(s) | name.contains(f"-{s}-") for s in NON_ATOMIC))
    many = _patterns(F.lower("description"), ORCHESTRATION)
    known = F.col("service").isin(*SERVICES)
    return _decided(x, (*keep, "tool_name"), {
        "duplication": [("same_name", "REJECT", F.col("distance") <= 2), ("near_name", "WARNING", F.col("distance").between(3, 4)), ("description_overlap", "REQUIRES_REVIEW", F.col("alike") >= TOOL_REVIEW), ("field_overlap", "REQUIRES_REVIEW", F.col("overlap") >= FIELD_REVIEW)],
        "service": [("service_missing", "REJECT", F.col("service") == ""), ("service_unknown", "WARNING", (F.col("service") != "") & ~known), ("like_elsewhere", "REQUIRES_REVIEW", (F.col("service") != "") & (F.col("elsewhere") >= ELSEWHERE_REVIEW))],
        "risk": [
            ("risk_unknown", "REJECT", wanted.isNull()), ("effects_mismatch", "REJECT", F.col("effects") != wanted), ("l0_not_idempotent", "REJECT", (F.col("risk") == "L0") & ~F.coalesce("idempotent", F.lit(False))),
            ("l4_without_approval", "REJECT", (F.col("risk") == "L4") & ~approved), ("l3_without_approval", "WARNING", (F.col("risk") == "L3") & ~approved), ("idempotence_undeclared", "WARNING", high & F.col("idempotent").isNull()),
        ],
        "reuse": [("no_callers", "REJECT", F.size("callers") == 0), ("one_caller", "WARNING", F.size("callers") == 1)],
        "form": [
            ("role_name", "REJECT", part), ("orchestration", "REJECT", many >= 2), ("orchestration_hint", "REQUIRES_REVIEW", many == 1),
            ("long_description", "WARNING", F.length("description") > LONG_DESCRIPTION), ("category_unknown", "WARNING", ~F.col("category").isin(*CATEGORIES)),
        ],
    })

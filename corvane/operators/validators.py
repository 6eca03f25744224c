"""Scored dimensions of skill and tool documents, their issues and result codes, and the decision of both gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import CATEGORIES, NAME, TOOL_NAME

#: Tool servers and what they offer.
SERVERS = {
    "device-status-mcp": ("get_device_status", "get_fault_history", "get_realtime_metrics", "list_devices", "get_charge_session"),
    "knowledge-base-mcp": ("search_knowledge_base",),
    "ticket-system-mcp": ("create_work_order", "update_work_order", "assign_technician", "list_available_technicians", "get_work_order", "list_work_orders"),
    "notification-mcp": ("send_feishu_message", "send_sms", "send_in_app_notification"),
    "verify-gate-mcp": ("request_approval",),
    "bpmn-tools": (
        "parse_business_intent", "extract_process_entities", "detect_description_ambiguity", "match_bpmn_template", "decompose_process_steps",
        "resolve_step_dependencies", "identify_parallel_steps", "map_steps_to_bpmn_elements", "classify_bpmn_task_types", "assign_bpmn_participants",
        "assemble_bpmn_model", "serialize_bpmn_xml", "optimize_bpmn_layout", "validate_bpmn_structural", "evaluate_intent_coverage",
    ),
}
#: Words and patterns that the dimensions look for.
CONTROL_TOOLS = ("restarting", "stopping", "disabling", "unlocking", "restart_charger", "stop_charging", "disable_outlet", "unlock_connector", "set_power_limit")
PERSONAL = r"(?i)\b(?:I |I'm |I'll |you |your )"
TRIGGERS = ("use when", "use this skill when", "use only when", "use after", "use for ", "triggers on", "trigger on", "triggered when", "activate when", "invoke when")
NOT_WHEN = ("Do NOT use when", "Do not use when", "do not use when")
VAGUE_PHRASES = ("general", "various", "handles", "manages", "deals with", "helps with")
AMBIGUOUS = ("process the data", "handle appropriately", "look up", "check the data")
CONJUNCTIONS = ("and also", "as well as", "additionally", "furthermore", "moreover")
SECTIONS = ("# Purpose", "# Trigger", "# Workflow", "# Constraints")
RESERVED = ("anthropic", "claude", "skill", "agent", "mcp")
CALLS_SKILL = r"(?i)use\s+the\s+\S+-skill|call\s+the\s+\S+-skill|invoke\s+\S+-skill|trigger\s+\S+-skill|使用.*skill|调用.*skill"
MARKDOWN = r"(?m)^\s*#+\s|\*\*[^*]+\*\*|\*[^*]+\*|^\s*[-*]\s|\[.+\]\(.+\)|^\s*>|```|`[^`]+`"
VOICE_SAMPLE = r"(?is)(?:voice output|TTS output|语音输出)[^\n]*\n(.*?)(?=\n#|\z)"
OUTPUT_KINDS = (r"(?i)generat|report|document|file", r"(?i)notif|alert|send.*message|push", r"(?i)restart|stop|control|disable|modify.*device", r"(?i)create.*order|work.*order|dispatch")
VAGUE_VERBS = ("handles", "processes", "deals with", "manages", "performs", "does", "works with", "takes care of")
VERBS = (
    "parse", "convert", "validate", "extract", "serialize", "compute", "map", "classify", "identify", "resolve", "assemble", "evaluate",
    "retrieve", "query", "match", "detect", "assign", "build", "generate", "transform", "check", "analyze", "calculate",
)
GENERIC_NAMES = ("tool", "helper", "util", "handler", "processor", "resolver")
MULTI_STEP = ("then", "after", "next", "finally", "step", "sequence", "first", "second", "third", "pipeline")
ORCHESTRATING = ("orchestrate", "pipeline", "workflow", "process-all", "run-all")
EFFECTS, TYPES, LEVELS = ("none", "read", "write", "external"), ("mcp", "http", "internal"), ("L0", "L1", "L2", "L3", "L4")
TOOL_KEYS = ("tool_name", "display_name", "description", "category", "risk", "ownership", "input_schema", "output_schema", "errors", "usage", "implementation")
#: Least scores of PASS, PASS_WITH_WARNINGS and REQUIRES_REVIEW.
SKILL_MARKS, TOOL_MARKS = (60, 45, 30), (45, 40, 30)
DECISIONS = ("REJECT", "REQUIRES_REVIEW", "PASS_WITH_WARNINGS", "PASS")


def _points(condition: Column, n: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)


def _total(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _within(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(10), score))


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return _total(*(_points(text.contains(w), 1) for w in words))


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _marked(score: Column, marks: tuple[int, int, int], clean: Column) -> Column:
    return F.when((score >= marks[0]) & clean, "PASS").when(score >= marks[1], "PASS_WITH_WARNINGS").when(score >= marks[2], "REQUIRES_REVIEW").otherwise("REJECT")


def skill_dimensions(skills: DataFrame) -> DataFrame:
    """name, d1 to d7, score, issues and result of skills (name, description, body, meta_skill, surfaces, n_evals, has_examples).

    n_evals: null without an evals file, -1 where it can't be read. Null texts count as empty.
    """
    name, desc, body, surfaces = (F.coalesce(F.col(c), F.lit("")) for c in ("name", "description", "body", "surfaces"))
    x = skills.select(name.alias("name"), desc.alias("desc"), body.alias("body"), F.lower(surfaces).contains("voice").alias("voice"),
                      F.lower(F.trim(F.coalesce(F.col("meta_skill").cast("string"), F.lit("")))).isin("true", "yes", "1").alias("meta"), "n_evals", F.coalesce("has_examples", F.lit(False)).alias("examples"))
    # A section ends at the next heading: a workflow's of the first level, that of constraints at any.
    x = x.withColumn("workflow", F.regexp_extract("body", r"(?s)# Workflow(.*?)(?=\n# [^#]|\z)", 1)).withColumn("rules", F.regexp_extract("body", r"(?s)# Constraints(.*?)(?=\n#|\z)", 1))
    x = x.withColumn("refs", F.transform(F.regexp_extract_all("body", F.lit(r"(?U)`([\w-]+:\w+)\("), F.lit(1)), lambda r: r))
    name, desc, body, flow, rules, meta = (F.col(c) for c in ("name", "desc", "body", "workflow", "rules", "meta"))
    low, low_body = F.lower(desc), F.lower(body)
    known = [f"{s}:{t}" for s, tools in SERVERS.items() for t in tools]
    unknown = F.size(F.filter("refs", lambda r: ~r.isin(*known)))
    has_flow, has_rules = body.contains("# Workflow"), body.contains("# Constraints")

    personal, triggered = desc.rlike(PERSONAL), _has(low, TRIGGERS)
    d1 = F.greatest(F.lit(0), _total(_points(~personal, 2), _points(triggered, 3), _points(_has(desc, NOT_WHEN), 2), _points(body.contains("# Trigger"), 2)) - _hits(low, VAGUE_PHRASES))

    parts = _count(body, r"## Phase\s+\d+|## Step\s+\d+|\[ \]\s+Step\s+\d+") + _count(body, r"(?md)^\s*\d+\.")
    as_meta = F.when(parts >= 3, 7).when(parts >= 1, 4).otherwise(2) + _points(flow.rlike("(?i)split|not suitable|escalate|flag|cannot|edge case|exception"), 3)
    steps, calls = _count(flow, r"\[\s*\]\s*Step\s*\d+"), _count(flow, r"(?U)`[\w-]+:\w+\(")
    as_usual = F.when(steps >= 2, 3).otherwise(steps) + F.when(calls >= 2, 4).otherwise(2 * calls) + _points(flow.rlike("(?i)error|fail|not found|exception|if .* → |else"), 3)
    d2 = F.when(~has_flow, 0).when(meta, as_meta).otherwise(F.greatest(F.lit(0), as_usual - _hits(F.lower(flow), AMBIGUOUS)))

    ungated = _has(low_body, CONTROL_TOOLS) & ~body.contains("verify-gate-mcp:request_approval")
    d3 = F.when(meta, 10).when(F.size("refs") == 0, 6).otherwise(F.greatest(F.lit(0), 10 - F.least(3 * unknown, F.lit(8)) - _points(ungated, 4)))

    spoken = F.col("voice") & F.regexp_extract(body, VOICE_SAMPLE, 1).rlike(MARKDOWN)
    d4 = _within(_total(_points(has_rules, 3), _points(body.rlike("device_id|station_id|order_id|user_id|query|date_from|date_to"), 3), _points(body.rlike("(?i)output|returns?|response|result|produces?"), 2), F.lit(2)) - _points(spoken, 2))

    d5 = F.when(~has_rules, 0).otherwise(_total(_points(rules.rlike("NEVER|never|Do not|do not|must not|MUST NOT"), 4), _points(rules.rlike("(?i)read-only|write|control|L[1-4]|scope|limited to"), 3), _points(rules.rlike("(?i)output must|required.*field|must include|following fields"), 3)))

    joined, calls_skill = _hits(low, CONJUNCTIONS), body.rlike(CALLS_SKILL)
    kinds = _total(*(_points(body.rlike(p), 1) for p in OUTPUT_KINDS))
    d6 = F.greatest(F.lit(0), 10 - 3 * joined - _points(calls_skill, 5) - _points(~meta & (kinds >= 3), 3))

    d7 = _within(_total(_points(body.rlike(r"(?i)example|input.*output|sample|e\.g\.|示例"), 3), _points(body.rlike("(?i)error.*example|edge case|不存在|找不到|超时|timeout|not found"), 2), _points(F.col("n_evals").isNotNull(), 3), _points(F.col("n_evals") >= 2, 2), _points(F.col("examples"), 1)))

    tooled = ~meta & (F.size("refs") > 0)
    reserved = reduce(lambda a, b: a | b, ((name == r) | name.startswith(f"{r}-") | name.endswith(f"-{r}") for r in RESERVED))
    named = name != ""
    problems = [
        (personal, "personal"), (~triggered, "no_trigger"), (~has_flow, "no_workflow"), (has_flow & ~meta & (steps == 0), "no_steps"), (has_flow & ~meta & (calls == 0), "no_tool_calls"),
        (tooled & (unknown > 0), "unregistered_tool"), (tooled & ungated, "no_approval"), (spoken, "voice_markdown"), (~has_rules, "no_constraints"), (joined > 0, "conjunction"), (calls_skill, "calls_skill"),
        (~named, "no_name"), (named & ~name.rlike(NAME), "name_pattern"), (name.contains("_"), "name_underscore"), (name.rlike(r"\p{Lu}"), "name_uppercase"), (named & reserved, "name_reserved"),
        *((~body.contains(s), f"missing {s[2:]}") for s in SECTIONS),
    ]
    scored = x.select("name", *(d.cast("int").alias(f"d{k}") for k, d in enumerate((d1, d2, d3, d4, d5, d6, d7), 1)), F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in problems))).alias("issues"))
    scored = scored.withColumn("score", _total(*(F.col(f"d{k}") for k in range(1, 8))))
    return scored.withColumn("result", _marked(F.col("score"), SKILL_MARKS, F.size("issues") == 0))


def tool_dimensions(tools: DataFrame) -> DataFrame:
    """name, d1 to d5, score, missing keys, zero dimensions (blocking) and result of tool documents.

    Columns as the document's top keys; a null column is a missing key. Without all keys the score is 0 and the result FAIL.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    name, desc = text("tool_name"), F.trim(text("description"))
    low = F.lower(desc)
    prefixed = reduce(lambda a, b: a | b, (name.startswith(f"{v}-") for v in VERBS))
    fine = F.when(desc == "", 0).when(F.length(desc) > 160, 1).otherwise(2 - _points(_has(low, VAGUE_VERBS), 1))
    d1 = _points(name.rlike(TOOL_NAME) & ~name.isin(*GENERIC_NAMES), 3) + _points(text("display_name") != "", 1) + fine
    d1 = F.when((name != "") & ~prefixed, F.greatest(F.lit(0), d1 - 1)).otherwise(d1 + 2)

    def schema(c: str) -> Column:
        fields = F.map_values(f"{c}.properties")
        n = F.coalesce(F.size(fields), F.lit(0))
        whole = F.size(F.filter(fields, lambda f: f["type"].isNotNull() & f["description"].isNotNull()))
        return _points(F.col(f"{c}.type") == "object", 1) + F.when(n > 0, 1 + F.floor(2 * whole / n)).otherwise(0)

    loose = reduce(lambda a, b: a | b, (F.coalesce(F.exists(F.map_values(f"{c}.properties"), lambda f: f["type"] == "any"), F.lit(False)) | F.coalesce(F.col(f"{c}.type") == "any", F.lit(False)) for c in ("input_schema", "output_schema")))
    d2 = _within(schema("input_schema") + schema("output_schema") + _points(F.col("input_schema.required").isNotNull(), 1) + _points(F.size("output_schema.properties") > 0, 1) - _points(loose, 2))

    level, effect = F.col("risk.level"), F.col("risk.side_effects")
    valid_level, valid_effect, high = F.coalesce(level.isin(*LEVELS), F.lit(False)), F.coalesce(effect.isin(*EFFECTS), F.lit(False)), F.coalesce(level.isin("L3", "L4"), F.lit(False))
    fits = F.when(effect.isin("write", "external") & ~high, -2).when((effect == "none") & (level != "L0"), 0).otherwise(2)
    approval = F.when(high, F.when(F.coalesce(F.col("risk.requires_approval"), F.lit(False)), 1).otherwise(-1)).otherwise(0)
    d3 = _within(_points(valid_level, 2) + _points(valid_effect, 2) + F.when(valid_level & valid_effect, fits).otherwise(0) + _points(F.col("risk.idempotent").isNotNull(), 1) + approval - _points((level == "L0") & ~effect.eqNullSafe("none"), 1))

    code = lambda e: F.coalesce(e["code"], F.lit(""))
    each = lambda e: _points(code(e).rlike("^[A-Z][A-Z0-9_]+$"), 1) + _points(F.length(e["message"]) >= 10, 1) + _points(e["retryable"].isNotNull(), 1)
    n = F.coalesce(F.size("errors"), F.lit(0))
    kind = lambda words: F.exists("errors", lambda e: _has(code(e), words))
    d4 = F.aggregate("errors", F.when(n == 1, 2).otherwise(4), lambda a, e: a + each(e)) - _points(F.exists("errors", lambda e: code(e).isin("ERROR", "UNKNOWN")), 1)
    d4 = F.when(n == 0, 0).otherwise(_within(d4 + _points(kind(("INPUT", "INVALID", "MISSING")) & kind(("FAILED", "TIMEOUT", "UNAVAILABLE")), 2)))

    d5 = F.greatest(F.lit(0), _points(F.col("category").isin(*CATEGORIES), 2) - _points(_hits(low, MULTI_STEP) >= 2, 1))
    d5 = F.greatest(F.lit(0), d5 - _points(_has(name, ORCHESTRATING), 2)) + _points(F.col("implementation.type").isin(*TYPES), 2)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    d5 = _within(_total(d5, *(_points(filled(c), 1) for c in ("implementation.endpoint", "ownership.team", "ownership.service")), *(_points(F.size(c) > 0, 1) for c in ("usage.when_to_use", "usage.called_by_skills"))))

    absent = F.array_compact(F.array(*(F.when(F.col(k).isNull(), F.lit(k)) for k in TOOL_KEYS)))
    x = tools.select(name.alias("name"), absent.alias("missing"), *(d.cast("int").alias(f"d{k}") for k, d in enumerate((d1, d2, d3, d4, d5), 1)))
    whole = F.size("missing") == 0
    x = x.select("name", "missing", *(F.when(whole, F.col(f"d{k}")).otherwise(0).alias(f"d{k}") for k in range(1, 6)))
    x = x.withColumn("score", _total(*(F.col(f"d{k}") for k in range(1, 6)))).withColumn("blocking", F.array_compact(F.array(*(F.when(F.col(f"d{k}") == 0, F.lit(f"d{k}")) for k in range(1, 6)))))
    return x.withColumn("result", F.when(whole, _marked(F.col("score"), TOOL_MARKS, F.lit(True))).otherwise("FAIL"))


def overall(validated: Column, admitted: Column) -> Column:
    """The worse of two results; an unknown one counts as a pass."""
    order = F.array(*(F.lit(d) for d in DECISIONS))
    place = lambda c: F.when(F.coalesce(c.isin(*DECISIONS), F.lit(False)), F.array_position(order, c)).otherwise(len(DECISIONS))
    return F.element_at(order, F.least(place(validated), place(admitted)).cast("int"))


def asset_reports(validated: DataFrame, checks: DataFrame, kind: str) -> DataFrame:
    """One report per asset: the validator's result and score beside the gate's worst check, and the overall decision."""
    worst = checks.select("name", F.when(F.col("result") == "WARNING", "PASS_WITH_WARNINGS").otherwise(F.col("result")).alias("result"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(d) for d in DECISIONS)), F.col("result")), F.lit(0)), F.lit(len(DECISIONS)))
    gate = worst.groupBy("name").agg(F.element_at(F.array(*(F.lit(d) for d in DECISIONS)), F.min(rank).cast("int")).alias("decision"))
    x = validated.select("name", "score", F.col("result").alias("validated")).join(gate, "name", "full")
    return x.select(F.lit(kind).alias("asset_type"), F.col("name").alias("asset_name"), "score", "validated", "decision", overall(F.col("validated"), F.col("decision")).alias("overall"))

"""Rules that are tables: statuses after a gate, risk by tools used, steps to go back to, contracts, capability kinds, compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import RISKS, risk_rank

#: The registry's status after an admission decision.
STATUS_AFTER = {"PASS": "approved", "PASS_WITH_WARNINGS": "approved", "REQUIRES_REVIEW": "submitted", "REJECT": "needs_revision"}

#: The least risk level of a skill that uses a server; tickets count where they are written.
RISK_OF_SERVER = {"device-status-mcp": "L1", "knowledge-base-mcp": "L1", "ticket-system-mcp": "L3", "notification-mcp": "L3", "verify-gate-mcp": "L4"}
READING = ("get", "list", "search", "query")

#: The layer and step to which a class of errors leads back, and what to do there.
GO_BACK = {
    "XML 格式错误": ("4", "bpmn-xml-serializer", "重新序列化"),
    "孤立节点/断链": ("3", "bpmn-model-assembler", "补充缺失的 sequenceFlow"),
    "任务类型错误": ("3", "bpmn-task-classifier", "重新分类"),
    "泳道分配错误": ("3", "bpmn-participant-organizer", "重新分配"),
    "步骤遗漏": ("2", "process-decomposer", "补充步骤"),
    "意图理解错误": ("1", "intent-parser", "重新解析"),
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def status_after(decision: Column) -> Column:
    """The registry's status after a gate's decision, null for one that isn't known; see `needs_note` for warnings."""
    return _lookup(STATUS_AFTER, decision)


def needs_note(decision: Column) -> Column:
    """Approved, but with a note."""
    return F.coalesce(decision == "PASS_WITH_WARNINGS", F.lit(False))


def least_risk(calls: DataFrame, skills: DataFrame) -> DataFrame:
    """skill_name, least_risk, understated of skills (skill_name, risk_level) by the tools they call (skill_name, server, tool): the
    highest of the servers' levels; a gate beside other servers makes L4, reading tickets asks for L1 only. Unknown
    servers count as L1; skills without calls have no least risk."""
    level = F.coalesce(_lookup(RISK_OF_SERVER, F.col("server")), F.lit("L1"))
    reads = (F.col("server") == "ticket-system-mcp") & F.split("tool", "_").getItem(0).isin(*READING)
    rank = risk_rank(F.when(reads, "L1").otherwise(level))
    g = calls.filter("skill_name is not null").groupBy("skill_name").agg(F.max(rank).alias("rank"))
    x = skills.select("skill_name", "risk_level").join(g, "skill_name", "left")
    name = F.try_element_at(F.array(*(F.lit(r) for r in RISKS)), F.col("rank").cast("int"))
    return x.select("skill_name", "risk_level", name.alias("least_risk"), F.coalesce(F.col("rank") > risk_rank(F.col("risk_level"), "L0"), F.lit(False)).alias("understated"))


def steps_back(errors: DataFrame, error_class: str = "error_class") -> DataFrame:
    """errors with layer, step and action to go back to; null for classes that aren't known."""
    table = errors.sparkSession.createDataFrame([(k, *v) for k, v in GO_BACK.items()], f"{error_class} string, layer string, step string, action string")
    return errors.join(F.broadcast(table), error_class, "left")  # six rows


def restart_layer(errors: DataFrame, run: str, error_class: str = "error_class") -> DataFrame:
    """The earliest layer that a run's errors lead back to, with its steps: what is run again from there on."""
    known = steps_back(errors, error_class).filter("layer is not null")
    first = known.groupBy(run).agg(F.min("layer").alias("layer"))
    return known.join(first, [run, "layer"]).groupBy(run, "layer").agg(F.sort_array(F.collect_set("step")).alias("steps"))  # of six


def contract_findings(definitions: DataFrame, *, contract_id: str, canonical: str, repositories: tuple[str, ...], contracts: tuple[str, ...], required: tuple[str, ...], stages: int = 7) -> DataFrame:
    """path, code, message of system definitions (path, body: JSON text, checksum: what its checksum file says or null, digest: sha256 of
    the file, peer: sha256 of its copy elsewhere or null): missing fields, other ids, missing repositories and
    contracts, a pipeline of too few stages, checksums and copies that differ. What isn't JSON has only that finding."""
    x = definitions.select("path", "checksum", "digest", "peer", F.try_parse_json("body").alias("v"))
    get = lambda p: F.try_variant_get("v", f"$.{p}", "string")
    missing = F.filter(F.array(*(F.when(get(n).isNull(), F.lit(n)) for n in sorted(required))), lambda c: c.isNotNull())
    n = F.coalesce(F.size(F.try_variant_get("v", "$.primary_pipeline", "array<variant>")), F.lit(0))
    checks = [
        ("missing_fields", F.size(missing) > 0, F.array_join(missing, ", ")),
        ("contract_id", ~get("contract_id").eqNullSafe(F.lit(contract_id)), F.coalesce(get("contract_id"), F.lit(""))),
        ("canonical_repository", ~get("canonical_repository").eqNullSafe(F.lit(canonical)), F.coalesce(get("canonical_repository"), F.lit(""))),
        *(("missing_repository", get(f"repositories['{r}']").isNull(), F.lit(r)) for r in repositories),
        *(("missing_contract", get(f"cross_repository_contracts['{c}']").isNull(), F.lit(c)) for c in contracts),
        ("short_pipeline", n < stages, n.cast("string")),
    ]
    body = F.col("v").isNotNull()
    found = [(code, body & bad, message) for code, bad, message in checks]
    found += [("not_json", ~body, F.lit("")), ("no_checksum", body & F.col("checksum").isNull(), F.lit("")), ("checksum", body & (F.split("checksum", " ").getItem(0) != F.col("digest")), F.col("digest")), ("peer_differs", body & (F.col("peer") != F.col("digest")), F.coalesce("peer", F.lit("")))]
    each = F.array(*(F.when(bad, F.struct(F.lit(code).alias("code"), message.alias("message"))) for code, bad, message in found))
    return x.select("path", F.explode(F.filter(each, lambda c: c.isNotNull())).alias("f")).select("path", "f.*")


def capability_kind(atomic: Column, whole_intent: Column) -> Column:
    """tool for one deterministic operation, skill for a whole intent that stands alone, else a step within a skill."""
    return F.when(F.coalesce(atomic, F.lit(False)), "tool").when(F.coalesce(whole_intent, F.lit(False)), "skill").otherwise("workflow_step")


def capability_findings(capabilities: DataFrame) -> DataFrame:
    """id, kind, code of capabilities (id, atomic, whole_intent, belongs_to_skill): steps without a skill that they belong to, or
    with one that isn't a skill among them."""
    x = capabilities.withColumn("kind", capability_kind(F.col("atomic"), F.col("whole_intent")))
    skills = x.filter("kind = 'skill'").select(F.col("id").alias("belongs_to_skill"), F.lit(True).alias("_known")).distinct()
    steps = x.filter("kind = 'workflow_step'").join(skills, "belongs_to_skill", "left")
    code = F.when(F.coalesce("belongs_to_skill", F.lit("")) == "", "no_parent").when(F.col("_known").isNull(), "unknown_parent")
    return steps.select("id", "kind", code.alias("code")).filter("code is not null")


def template_counts(logs: DataFrame, message: str, at: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, template, n, share, first and last: how often each message template occurs, its share among its group, and when."""
    x = logs.filter(F.col(message).isNotNull()).select(*by, X.message_template(F.col(message)).alias("template"), F.col(at).alias("_at"))
    n = x.groupBy(*by, "template").agg(F.count("*").alias("n"), F.min("_at").alias("first"), F.max("_at").alias("last"))
    if not by:
        total = n.agg(F.sum("n").alias("_total"))
        return n.join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")  # one row
    return n.join(n.groupBy(*by).agg(F.sum("n").alias("_total")), list(by)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def version_key(version: Column) -> Column:
    """A version's numbers, for comparing: 1.10 comes after 1.9, and 1.0 equals 1; null for what has no number."""
    numbers = F.transform(F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("bigint"))
    last = F.array_max(F.transform(numbers, lambda x, i: F.when(x != 0, i + 1).otherwise(1)))
    return F.when(F.size(numbers) > 0, F.slice(numbers, 1, last))


def compatibility(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """asked (item, target, version) with `verdict` and `rule_id`: compatible or not by the first rule (rule_id, item, target, low, high, works) whose range
    holds the version, ends included and open where null; unknown where none does."""
    r = rules.select("rule_id", "item", "target", version_key(F.col("low")).alias("_low"), version_key(F.col("high")).alias("_high"), "works", F.col("low").isNull().alias("_from"), F.col("high").isNull().alias("_to"))
    a = asked.select("item", "target", "version").distinct().withColumn("_v", version_key(F.col("version")))
    held = (F.col("_from") | (F.col("_v") >= F.col("_low"))) & (F.col("_to") | (F.col("_v") <= F.col("_high")))
    hit = a.join(r, ["item", "target"]).filter(held & F.col("_v").isNotNull())
    first = hit.groupBy("item", "target", "version").agg(F.min(F.struct("rule_id", "works")).alias("r"))
    out = asked.join(first, ["item", "target", "version"], "left")
    return out.select(*asked.columns, F.when(F.col("r.works"), "compatible").when(~F.col("r.works"), "incompatible").otherwise("unknown").alias("verdict"), F.col("r.rule_id").alias("rule_id"))


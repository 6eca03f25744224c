"""Queries of validators, reports and change impact over documents derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as H
from ..operators import rules as R
from ..operators import validators as V
from .governance import query
from .tables import REGISTRY_SQL, skills, table, tools

#: Parts that the derived documents are put together from.
DESCRIPTIONS = ("Use when a charger reports a fault. Do NOT use when offline.", "I help you with various general things and also handles reports as well as alerts", "Triggers on tickets; manages queues, deals with various requests additionally", "")
FLOWS = (
    "[ ] Step 1: `device-status-mcp:get_device_status(device_id)`\n[ ] Step 2: `ticket-system-mcp:create_work_order(order_id)`\nif error → stop",
    "[ ] Step 1: `unknown-mcp:do_it(x)` then look up and check the data",
    "1. read\n2. write\n3. flag edge case",
    "restart_charger then `verify-gate-mcp:request_approval(user_id)`",
    "unlocking it: `device-status-mcp:no_such_tool(a)` `bad:one(b)` `bad:two(c)`",
)
RULES = ("NEVER write. Scope L1. Output must list fields", "be nice", "do not send; following fields are a must")
NOTES = ("Example: input a, output b. Voice output sample\n**bold** text", "error example: timeout; generate a report, notify and restart", "call the other-skill now", "plain")
TOOL_TEXTS = ("parses the text of a request", "handles the request first, then the next step", "validates " * 20, "", "Performs sequence of things finally")


def _pick(values, by):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def skill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    body = F.concat(
        F.when(k % 2 == 0, "# Purpose\nhelp\n").otherwise(""), F.when(k % 3 != 1, "# Trigger\nnow\n").otherwise(""),
        F.when(k % 6 < 5, F.concat(F.lit("# Workflow\n"), _pick(FLOWS, k % 6), F.lit("\n"))).otherwise(""),
        F.when(F.floor(k / 4) % 4 < 3, F.concat(F.lit("# Constraints\n"), _pick(RULES, F.floor(k / 4) % 4), F.lit("\n"))).otherwise(""),
        F.lit("# Notes\n"), _pick(NOTES, k % 7 % 4),
    )
    name = F.when(k % 8 == 0, "Bad_Name").when(k % 8 == 1, "skill-x").when(k % 8 > 2, F.concat(F.lit("checking-charger-"), k.cast("string")))
    return table(spark, sf_dir, "customer").select(
        name.alias("name"), _pick(DESCRIPTIONS, k).alias("description"), body.alias("body"), F.when(k % 5 == 0, "True").alias("meta_skill"), F.when(k % 3 == 0, "chat, Voice").otherwise("chat").alias("surfaces"),
        F.when(k % 4 == 1, -1).when(k % 4 == 2, 1).when(k % 4 == 3, 3).alias("n_evals"), (k % 2 == 0).alias("has_examples"),
    )


_KNOWN = "[" + ", ".join(f"'{s}:{t}'" for s, ts in V.SERVERS.items() for t in ts) + "]"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _n(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


_SKILL_SQL = rf"""WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 8 = 0 THEN 'Bad_Name' WHEN c_custkey % 8 = 1 THEN 'skill-x' WHEN c_custkey % 8 > 2 THEN 'checking-charger-' || c_custkey ELSE '' END AS name,
  ({_list(DESCRIPTIONS)})[c_custkey % 4 + 1] AS d, CASE WHEN c_custkey % 6 < 5 THEN ({_list(FLOWS)})[c_custkey % 6 + 1] END AS w, CASE WHEN (c_custkey // 4) % 4 < 3 THEN ({_list(RULES)})[(c_custkey // 4) % 4 + 1] END AS c,
  ({_list(NOTES)})[c_custkey % 7 % 4 + 1] AS n, c_custkey % 5 = 0 AS meta, c_custkey % 3 = 0 AS voice FROM customer),
q AS (SELECT *, CASE WHEN k % 2 = 0 THEN '# Purpose' || chr(10) || 'help' || chr(10) ELSE '' END || CASE WHEN k % 3 <> 1 THEN '# Trigger' || chr(10) || 'now' || chr(10) ELSE '' END
  || coalesce('# Workflow' || chr(10) || w || chr(10), '') || coalesce('# Constraints' || chr(10) || c || chr(10), '') || '# Notes' || chr(10) || n AS b FROM p),
r AS (SELECT *, lower(d) AS ld, len(regexp_extract_all(coalesce(w, ''), '\[\s*\]\s*Step\s*\d+')) AS steps, len(regexp_extract_all(coalesce(w, ''), '`[\w-]+:\w+\(')) AS calls,
  len(regexp_extract_all(b, '(?m)^\s*\d+\.')) + len(regexp_extract_all(b, '\[ \]\s+Step\s+\d+')) AS parts, regexp_extract_all(b, '`([\w-]+:\w+)\(', 1) AS refs,
  regexp_matches(d, '(?i)\b(I |I''m |I''ll |you |your )') AS personal, {_any("lower(d)", V.TRIGGERS)} AS triggered, {_n("lower(d)", V.CONJUNCTIONS)} AS joined, regexp_matches(b, '(?i)(use|call)\s+the\s+\S+-skill') AS calls_skill,
  {_any("lower(b)", V.CONTROL_TOOLS)} AND NOT contains(b, 'verify-gate-mcp:request_approval') AS ungated, voice AND contains(n, 'Voice output') AS spoken,
  CAST(regexp_matches(b, '(?i)generat|report|document|file') AS INT) + CAST(regexp_matches(b, '(?i)notif|alert|push') AS INT) + CAST(regexp_matches(b, '(?i)restart|stop|control|disable') AS INT) + CAST(regexp_matches(b, '(?i)create.*order|work.*order|dispatch') AS INT) AS kinds FROM q),
s AS (SELECT *, len(list_filter(refs, lambda x: NOT list_contains({_KNOWN}, x))) AS unknown FROM r),
t AS (SELECT *, greatest(0, 2 * CAST(NOT personal AS INT) + 3 * CAST(triggered AS INT) + 2 * CAST({_any("d", V.NOT_WHEN)} AS INT) + 2 * CAST(k % 3 <> 1 AS INT) - {_n("ld", V.VAGUE_PHRASES)}) AS d1,
  CASE WHEN w IS NULL THEN 0 WHEN meta THEN CASE WHEN parts >= 3 THEN 7 WHEN parts >= 1 THEN 4 ELSE 2 END + 3 * CAST(regexp_matches(w, '(?i)split|not suitable|escalate|flag|cannot|edge case|exception') AS INT)
    ELSE greatest(0, CASE WHEN steps >= 2 THEN 3 ELSE steps END + 2 * least(calls, 2) + 3 * CAST(regexp_matches(w, '(?i)error|fail|not found|exception|if .* → |else') AS INT) - {_n("lower(w)", V.AMBIGUOUS)}) END AS d2,
  CASE WHEN meta THEN 10 WHEN len(refs) = 0 THEN 6 ELSE greatest(0, 10 - least(3 * unknown, 8) - 4 * CAST(ungated AS INT)) END AS d3,
  greatest(0, 3 * CAST(c IS NOT NULL AS INT) + 3 * CAST(regexp_matches(b, 'device_id|station_id|order_id|user_id|query|date_from|date_to') AS INT) + 2 * CAST(regexp_matches(b, '(?i)output|return|response|result|produce') AS INT) + 2 - 2 * CAST(spoken AS INT)) AS d4,
  CASE WHEN c IS NULL THEN 0 ELSE 4 * CAST(regexp_matches(c, 'NEVER|never|[Dd]o not|must not|MUST NOT') AS INT) + 3 * CAST(regexp_matches(c, '(?i)read-only|write|control|L[1-4]|scope|limited to') AS INT) + 3 * CAST(regexp_matches(c, '(?i)output must|required.*field|must include|following fields') AS INT) END AS d5,
  greatest(0, 10 - 3 * joined - 5 * CAST(calls_skill AS INT) - 3 * CAST(NOT meta AND kinds >= 3 AS INT)) AS d6,
  least(10, 3 * CAST(regexp_matches(b, '(?i)example|input.*output|sample|e\.g\.') AS INT) + 2 * CAST(regexp_matches(b, '(?i)error.*example|edge case|timeout|not found') AS INT) + CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 3 THEN 5 ELSE 3 END + CAST(k % 2 = 0 AS INT)) AS d7 FROM s),
u AS (SELECT *, d1 + d2 + d3 + d4 + d5 + d6 + d7 AS score, array_to_string(list_filter([CASE WHEN personal THEN 'personal' END, CASE WHEN NOT triggered THEN 'no_trigger' END, CASE WHEN w IS NULL THEN 'no_workflow' END,
  CASE WHEN w IS NOT NULL AND NOT meta AND steps = 0 THEN 'no_steps' END, CASE WHEN w IS NOT NULL AND NOT meta AND calls = 0 THEN 'no_tool_calls' END, CASE WHEN NOT meta AND unknown > 0 THEN 'unregistered_tool' END,
  CASE WHEN NOT meta AND len(refs) > 0 AND ungated THEN 'no_approval' END, CASE WHEN spoken THEN 'voice_markdown' END, CASE WHEN c IS NULL THEN 'no_constraints' END, CASE WHEN joined > 0 THEN 'conjunction' END, CASE WHEN calls_skill THEN 'calls_skill' END,
  CASE WHEN name = '' THEN 'no_name' END, CASE WHEN name = 'Bad_Name' THEN 'name_pattern' END, CASE WHEN name = 'Bad_Name' THEN 'name_underscore' END, CASE WHEN name = 'Bad_Name' THEN 'name_uppercase' END, CASE WHEN name = 'skill-x' THEN 'name_reserved' END,
  CASE WHEN k % 2 = 1 THEN 'missing Purpose' END, CASE WHEN k % 3 = 1 THEN 'missing Trigger' END, CASE WHEN w IS NULL THEN 'missing Workflow' END, CASE WHEN c IS NULL THEN 'missing Constraints' END], lambda x: x IS NOT NULL), ',') AS issues FROM t)
SELECT name, d1, d2, d3, d4, d5, d6, d7, score, issues, CASE WHEN score >= 60 AND issues = '' THEN 'PASS' WHEN score >= 45 THEN 'PASS_WITH_WARNINGS' WHEN score >= 30 THEN 'REQUIRES_REVIEW' ELSE 'REJECT' END AS result FROM u"""


@query(_SKILL_SQL)
def val_skill_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.skill_dimensions(skill_documents(spark, sf_dir)).withColumn("issues", F.array_join("issues", ","))


def tool_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    field = lambda kind, text: F.struct(F.lit(kind).cast("string").alias("type") if not isinstance(kind, type(k)) else kind.alias("type"), text.cast("string").alias("description"))
    error = lambda code, message, retry: F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(retry).cast("boolean").alias("retryable"))
    name = F.when(k % 6 == 0, F.concat(F.lit("parse-intent-"), k.cast("string"))).when(k % 6 == 1, "tool").when(k % 6 == 2, "Bad_Name").when(k % 6 == 3, F.concat(F.lit("run-all-"), k.cast("string"))).when(k % 6 == 4, F.concat(F.lit("check-pipeline-"), k.cast("string")))
    errors = F.when(k % 4 == 1, F.array(error("ERROR", "short", None))).when(k % 4 == 2, F.array(error("INVALID_INPUT", "the input is invalid", True), error("EXECUTION_FAILED", "the execution failed", False)))
    errors = errors.when(k % 4 == 3, F.array(error("bad", "xx", None), error("UNKNOWN", "something is unknown", True), error("TIMEOUT", "it took too long", True))).otherwise(F.filter(F.array(error("", "", None)), lambda _: F.lit(False)))
    ins = F.create_map(F.lit("a"), field("string", F.lit("x")), F.lit("b"), field(F.when(k % 5 == 0, "any").otherwise("int"), F.when(k % 3 != 0, "y")))
    outs = F.map_filter(F.create_map(F.lit("r"), field("string", F.lit("z"))), lambda _, __: k % 6 != 0)
    strings = lambda c, v: F.when(c, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "supplier").select(
        name.alias("tool_name"), F.when(k % 4 == 3, "").otherwise(F.concat(F.lit("Tool "), k.cast("string"))).alias("display_name"), _pick(TOOL_TEXTS, k).alias("description"), _pick(("parsing", "validation", "cooking"), k).alias("category"),
        F.struct(_pick(("L0", "L1", "L2", "L3", "L4"), k).alias("level"), _pick(("none", "read", "write", "external", "bogus"), k % 7).alias("side_effects"), F.when(k % 4 != 0, True).alias("idempotent"), (k % 2 == 0).alias("requires_approval")).alias("risk"),
        F.struct(F.lit("team").alias("team"), F.when(k % 3 == 0, "").otherwise("svc").alias("service")).alias("ownership"),
        F.struct(F.when(k % 2 == 0, "object").otherwise("array").alias("type"), ins.alias("properties"), F.when(k % 4 != 1, F.array(F.lit("a"))).alias("required")).alias("input_schema"),
        F.struct(F.lit("object").alias("type"), outs.alias("properties")).alias("output_schema"), errors.alias("errors"),
        F.when(k % 11 != 0, F.struct(strings(k % 3 != 1, "w").alias("when_to_use"), strings(k % 2 == 1, "s").alias("called_by_skills"))).alias("usage"),
        F.struct(_pick(("mcp", "http", "ftp"), k).alias("type"), F.when(k % 5 == 2, "").otherwise("e").alias("endpoint")).alias("implementation"),
    )


@query("""WITH t AS (SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'parse-intent-' || s_suppkey WHEN 1 THEN 'tool' WHEN 2 THEN 'Bad_Name' WHEN 3 THEN 'run-all-' || s_suppkey WHEN 4 THEN 'check-pipeline-' || s_suppkey ELSE '' END AS name,
  s_suppkey % 5 AS lv, CASE WHEN s_suppkey % 7 >= 5 THEN s_suppkey % 7 - 5 ELSE s_suppkey % 7 END AS fx FROM supplier),
a AS (SELECT *, greatest(0, CASE WHEN k % 6 IN (0, 3, 4) THEN 3 ELSE 0 END + CASE WHEN k % 4 = 3 THEN 0 ELSE 1 END + CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 1 END + CASE WHEN k % 6 IN (1, 2, 3) THEN -1 ELSE 2 END) AS d1,
  greatest(0, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + 1 + CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END + 1 + CASE WHEN k % 6 = 0 THEN 0 ELSE 3 END + CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END + CASE WHEN k % 6 = 0 THEN 0 ELSE 1 END - CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END) AS d2,
  greatest(0, 2 + CASE WHEN fx = 4 THEN 0 ELSE 2 END + CASE WHEN fx = 4 THEN 0 WHEN fx IN (2, 3) AND lv < 3 THEN -2 WHEN fx = 0 AND lv <> 0 THEN 0 ELSE 2 END + CASE WHEN k % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN lv < 3 THEN 0 WHEN k % 2 = 0 THEN 1 ELSE -1 END - CASE WHEN lv = 0 AND fx <> 0 THEN 1 ELSE 0 END) AS d3,
  CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 + 1 - 1 WHEN 2 THEN 10 ELSE 9 END AS d4,
  greatest(0, greatest(0, CASE WHEN k % 3 = 2 THEN 0 ELSE 2 END - CASE WHEN k % 5 IN (1, 4) THEN 1 ELSE 0 END) - CASE WHEN k % 6 IN (3, 4) THEN 2 ELSE 0 END) + CASE WHEN k % 3 = 2 THEN 0 ELSE 2 END + CASE WHEN k % 5 = 2 THEN 0 ELSE 1 END + 1 + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 3 = 1 THEN 0 ELSE 1 END + k % 2 AS d5 FROM t),
b AS (SELECT k, name, CASE WHEN k % 11 = 0 OR name = '' THEN 0 ELSE 1 END AS whole, array_to_string(list_filter([CASE WHEN name = '' THEN 'tool_name' END, CASE WHEN k % 11 = 0 THEN 'usage' END], lambda x: x IS NOT NULL), ',') AS missing, d1, d2, d3, d4, d5 FROM a),
c AS (SELECT name, missing, whole, d1 * whole AS d1, d2 * whole AS d2, d3 * whole AS d3, d4 * whole AS d4, d5 * whole AS d5 FROM b), e AS (SELECT *, d1 + d2 + d3 + d4 + d5 AS score FROM c)
SELECT name, missing, d1, d2, d3, d4, d5, score, array_to_string(list_filter([CASE WHEN d1 = 0 THEN 'd1' END, CASE WHEN d2 = 0 THEN 'd2' END, CASE WHEN d3 = 0 THEN 'd3' END, CASE WHEN d4 = 0 THEN 'd4' END, CASE WHEN d5 = 0 THEN 'd5' END], lambda x: x IS NOT NULL), ',') AS blocking,
  CASE WHEN whole = 0 THEN 'FAIL' WHEN score >= 45 THEN 'PASS' WHEN score >= 40 THEN 'PASS_WITH_WARNINGS' WHEN score >= 30 THEN 'REQUIRES_REVIEW' ELSE 'REJECT' END AS result FROM e""")
def val_tool_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.tool_dimensions(tool_documents(spark, sf_dir))
    return x.withColumn("missing", F.array_join("missing", ",")).withColumn("blocking", F.array_join("blocking", ","))


_R, _C = "(['PASS','PASS_WITH_WARNINGS','REQUIRES_REVIEW','REJECT','ERROR'])", "(['PASS','WARNING','REQUIRES_REVIEW','REJECT'])"


@query(f"""WITH v AS (SELECT 'asset-' || c_custkey AS name, c_custkey % 70 AS score, {_R}[c_custkey % 5 + 1] AS validated FROM customer WHERE c_custkey % 9 <> 0),
c AS (SELECT 'asset-' || (o_custkey % 200) AS name, max((o_orderkey // 3) % 4) AS worst FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1),
d AS (SELECT name, (['PASS','PASS_WITH_WARNINGS','REQUIRES_REVIEW','REJECT'])[worst + 1] AS decision, worst FROM c)
SELECT 'skill' AS asset_type, coalesce(v.name, d.name) AS asset_name, score, validated, decision, (['PASS','PASS_WITH_WARNINGS','REQUIRES_REVIEW','REJECT'])[greatest(coalesce(worst, 0), CASE validated WHEN 'PASS_WITH_WARNINGS' THEN 1 WHEN 'REQUIRES_REVIEW' THEN 2 WHEN 'REJECT' THEN 3 ELSE 0 END) + 1] AS overall
FROM v FULL JOIN d ON v.name = d.name""")
def ci01_asset_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    v = table(spark, sf_dir, "customer").filter(k % 9 != 0).select(F.concat(F.lit("asset-"), k.cast("string")).alias("name"), (k % 70).alias("score"), _pick(("PASS", "PASS_WITH_WARNINGS", "REQUIRES_REVIEW", "REJECT", "ERROR"), k).alias("result"))
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0")
    checks = o.select(F.concat(F.lit("asset-"), (F.col("o_custkey") % 200).cast("string")).alias("name"), F.lit("c").alias("check"), _pick(("PASS", "WARNING", "REQUIRES_REVIEW", "REJECT"), F.floor(F.col("o_orderkey") / 3)).alias("result"))
    return V.asset_reports(v, checks, "skill")


_CHANGED = "SELECT DISTINCT 'bundle-' || (o_orderkey % 97) AS folder, o_orderkey % 2 = 0 AS tool FROM orders WHERE o_orderkey % 97 < 12 AND o_orderkey % 3 < 2"


@query(f"""WITH {REGISTRY_SQL}, ch AS ({_CHANGED}), sp AS (SELECT *, 'bundle-' || (CAST(substr(skill_name, 7) AS BIGINT) % 160) || '/' || skill_name AS path FROM skills),
tp AS (SELECT tool_name, 'bundle-' || (s_suppkey % 160) || '/x' AS path FROM tools), hit AS (SELECT DISTINCT u.consumer AS skill_name FROM uses u JOIN tp USING (tool_name) JOIN ch ON ch.tool AND starts_with(tp.path, ch.folder)),
own AS (SELECT DISTINCT skill_name FROM sp JOIN ch ON NOT ch.tool AND starts_with(sp.path, ch.folder)), direct AS (SELECT skill_name, bundle_scope FROM skills WHERE skill_name IN (SELECT skill_name FROM hit) OR skill_name IN (SELECT skill_name FROM own))
SELECT skill_name, bundle_scope FROM direct UNION ALL SELECT DISTINCT skill_name, NULL FROM skills WHERE dep IN (SELECT skill_name FROM own) AND skill_name NOT IN (SELECT skill_name FROM direct)""")
def jn14_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    changed = table(spark, sf_dir, "orders").filter((k % 97 < 12) & (k % 3 < 2)).select(F.concat(F.lit("bundle-"), (k % 97).cast("string"), F.lit("/a/"), F.when(k % 2 == 0, "TOOL.md").otherwise("SKILL.md")).alias("path"))
    folder = lambda n, tail: F.concat(F.lit("bundle-"), (F.element_at(F.split(n, "-"), 2).cast("bigint") % 160).cast("string"), F.lit("/"), tail)
    s = skills(spark, sf_dir).withColumn("path", folder(F.col("skill_name"), F.col("skill_name")))
    t = tools(spark, sf_dir).withColumn("path", folder(F.col("tool_name"), F.lit("x")))
    return H.blast_radius(changed, s, t)


@query(f"WITH {REGISTRY_SQL} SELECT status IN ('approved','restricted') AS allowed, status, count(*) AS n FROM skills GROUP BY 1, 2")
def cat01_runtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.catalog_summary(skills(spark, sf_dir), "skill_name")


@query("""WITH e AS (SELECT 's' || n_regionkey AS src, 't' || n_nationkey AS dst, n_nationkey % 2 = 0 AND n_regionkey < 3 AS cond, n_nationkey % 3 = 0 AS par FROM nation WHERE n_regionkey > 0 OR n_nationkey = 0
  UNION ALL SELECT 't' || n_nationkey, 'end', FALSE, FALSE FROM nation WHERE n_nationkey % 5 = 1), st AS (SELECT src AS step_id FROM e UNION SELECT dst FROM e),
o AS (SELECT src, count(*) AS n, count_if(cond) AS c, count_if(par) AS p FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS n FROM e GROUP BY 1)
SELECT step_id, CASE WHEN coalesce(i.n, 0) = 0 AND o.n = 1 THEN 'startEvent' WHEN o.n IS NULL THEN 'endEvent' WHEN o.n > 1 AND c > 1 THEN 'exclusiveGateway' WHEN o.n > 1 AND p > 0 THEN 'parallelGateway' ELSE 'task' END AS bpmn_type
FROM st LEFT JOIN o ON o.src = step_id LEFT JOIN i ON i.dst = step_id""")
def gr08_element_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = n.filter("n_regionkey > 0 or n_nationkey = 0").select(name("s", "n_regionkey").alias("src"), name("t", "n_nationkey").alias("dst"), F.when((k % 2 == 0) & (F.col("n_regionkey") < 3), "x").alias("condition"), (k % 3 == 0).alias("parallel"))
    b = n.filter("n_nationkey % 5 = 1").select(name("t", "n_nationkey").alias("src"), F.lit("end").alias("dst"), F.lit(None).cast("string").alias("condition"), F.lit(False).alias("parallel"))
    e = a.unionByName(b)
    return H.element_map(e.select(F.col("src").alias("step_id")).union(e.select("dst")).distinct(), e)


@query("""SELECT c_nationkey AS doc, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE lower(c_mktsegment) || ' guide' END AS anchor, min(c_custkey) AS place FROM customer
WHERE c_custkey % 3 < 2 AND c_custkey % 7 <> 0 GROUP BY 1, 2""")
def flt07_link_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    links = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), _pick(("uri", " file ", "page"), k).alias("kind"), F.when(k % 7 == 0, " x ").otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" \n guide "))).alias("anchor_text"), k.alias("place"))
    return H.link_references(links)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def flt06_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return H.pending(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("""SELECT o_custkey, count(*) AS n_source, count_if(o_orderstatus = 'F') AS n_merged, count(*) - count_if(o_orderstatus = 'F') AS delta FROM orders GROUP BY 1 HAVING count(*) > count_if(o_orderstatus = 'F')""")
def chk03_count_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return H.count_delta(o, o.filter("o_orderstatus = 'F'"), "o_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth = 1")
def qry04_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS checksum, count(*) OVER (PARTITION BY sha256(text)) > 1 AS has_peer FROM documents WHERE text IS NOT NULL")
def hsh06_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return H.peers(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")))


@query("""SELECT conv_id AS doc, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, CASE WHEN conv_id % 3 = 0 THEN 'evidence' ELSE 'normative' END AS layer FROM conversations GROUP BY conv_id""")
def chk14_chunk_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc")
    return H.chunk_header(c, c.select("doc").distinct().withColumn("layer", F.when(F.col("doc") % 3 == 0, "evidence")))


@query("SELECT doc_id, max(len(string_split(line, ' '))) AS widest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def agg17_row_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.split("text", "\n"), lambda line: F.size(F.split(line, " ")))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.array_max(rows).alias("widest"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part QUALIFY place <= 50")
def srt03_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 names in any case."""
    first = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("low")).orderBy("low", "p_partkey").limit(50)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("low", "p_partkey"))).alias("x"))  # 50 rows
    return listed.select(F.posexplode("x").alias("pos", "x")).select("x.p_partkey", (F.col("pos") + 1).cast("bigint").alias("place"))


@query(f"""WITH {REGISTRY_SQL}, k AS (SELECT *, CAST(substr(skill_name, 7) AS BIGINT) AS k FROM skills)
SELECT 'metadata_drift' AS code, skill_name AS asset_name, concat_ws(',', CASE WHEN k % 4 = 0 AND status <> 'draft' THEN 'status' END, CASE WHEN k % 6 = 0 THEN 'risk_level' END) AS message FROM k
WHERE k % 10 <> 0 AND (k % 4 = 0 AND status <> 'draft' OR k % 6 = 0) UNION ALL SELECT 'missing_in_fs', skill_name, 'registered, but there is no file' FROM k WHERE k % 10 = 0""")
def jn03_metadata_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = skills(spark, sf_dir)
    k = F.element_at(F.split("skill_name", "-"), 2).cast("bigint")
    found = s.filter(k % 10 != 0).select("skill_name", F.when(k % 4 == 0, "draft").otherwise(F.col("status")).alias("status"), F.when(k % 6 != 0, F.col("risk_level")).alias("risk_level"))
    return R.alignment(s, found, "skill", "skill_name", ["status", "risk_level"]).select("code", "asset_name", "message")

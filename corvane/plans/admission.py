"""Queries of the admission gates over candidates derived from the driver tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission as A
from ..operators import rules as R
from ..operators.validators import TRIGGERS
from .governance import query
from .tables import table

#: Parts that candidates are put together from; {n} is a nation's name.
DESCRIPTIONS = (
    "Checks the charging stations of {n} for faults", "Use when the charging stations of {n} show faults, as checks for all and any of them do",
    "Triggers on faults of charging stations, manages reports as well as alerts", "short", "Use when the meters of {n} have to be read, one by one, and also told",
)
BODIES = (
    "# Workflow\n[ ] Step 1 read\n[ ] Step 2 look\n[ ] Step 3 write it\non error stop\n# Notes\nrestart", "# Purpose\nfault diagnosis of hardware log charger repair\n# Workflow\n## A\nrestart the charger\n# Notes\nx",
    "# Workflow\nrestart it after verify-gate-mcp:request_approval\n# Trigger\nbilling of a customer session, account and user", "# Workflow\n1. create a bpmn process diagram with entity, intent and xml\n## Then\nfault error log repair charger\n",
    "# Notes\ncall the reading-skill", "nothing at all",
)
TOOL_TEXTS = ("Reads the meters of {n} for the bill", "Reads the meters of {n}", "handles a pipeline, then calls another tool", "coordinates " + "the meters and the bills and " * 10, "")
FIELDS = ("unit", "zone", "text", "day")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, by):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))


def _hits(text: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w)))"


def _words(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{3,}}'))"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def _case(*findings: tuple[str, str]) -> str:
    """The rank of the worst of (condition, rank)."""
    return "greatest(0, " + ", ".join(f"CASE WHEN {c} THEN {r} ELSE 0 END" for c, r in findings) + ")"


_LEVELS, _DECISIONS = _list(A.LEVELS), _list(A.DECISIONS)
_DOMAIN = ", ".join(f"CASE WHEN scope <> '{s}' AND {_hits('operative', w)} >= 5 THEN 1 ELSE 0 END" for s, w in R.DOMAINS.items())
_CALLS = " OR ".join(f"regexp_matches(lower(body), '{p}')" for p in A.SKILL_CALLS)


def _part(title: str) -> str:
    return f"coalesce(lower(regexp_extract(body, '(?s)# {title}(.*?)(\\n#|\\z)', 1)), '')"


def skill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.lower("n_name")
    own = F.concat(F.lit("skill-"), n)
    name = F.when(k % 7 == 0, own).when(k % 7 == 1, F.concat(own, F.lit("s"))).when(k % 7 > 2, F.concat(F.lit("checking-"), k.cast("string")))
    x = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.select(
        "c_custkey", name.alias("name"), F.replace(_pick(DESCRIPTIONS, k), F.lit("{n}"), n).alias("description"), _pick(BODIES, F.floor(k / 5)).alias("body"),
        _pick(("platform", "ops-agent", "customer-agent", "unheard-of", "", "diagnosis-agent", "bpmn-agent"), F.floor(k / 3)).alias("bundle_scope"), F.when(k % 11 != 0, _pick(("L1", "l2", "L3", "L4"), F.floor(k / 2))).alias("risk_level"),
    )


def skill_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lower("n_name")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("skill-"), n).alias("skill_name"), F.concat(F.lit("Checks charging stations of "), n, F.lit(" for faults")).alias("purpose"))


@query(f"""WITH reg AS (SELECT 'skill-' || lower(n_name) AS skill_name, {_words("'Checks charging stations of ' || n_name || ' for faults'")} AS words FROM nation),
c0 AS (SELECT c_custkey, lower(n_name) AS n, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
c1 AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'skill-' || n WHEN k % 7 = 1 THEN 'skill-' || n || 's' WHEN k % 7 > 2 THEN 'checking-' || k ELSE '' END AS name,
  replace(({_list(DESCRIPTIONS)})[k % 5 + 1], '{{n}}', n) AS description, ({_list(BODIES)})[(k // 5) % 6 + 1] AS body,
  (['platform','ops-agent','customer-agent','unheard-of','','diagnosis-agent','bpmn-agent'])[(k // 3) % 7 + 1] AS scope, CASE WHEN k % 11 <> 0 THEN upper((['L1','l2','L3','L4'])[(k // 2) % 4 + 1]) ELSE 'L1' END AS risk FROM c0),
c2 AS (SELECT *, lower(description) AS low, lower(regexp_extract(body, '(?s)# Workflow(.*?)(\\n#[^#]|\\z)', 1)) AS flow,
  lower(description) || ' ' || {_part("Workflow")} || ' ' || {_part("Purpose")} || ' ' || {_part("Trigger")} AS operative, {_words("description")} AS words FROM c1),
m AS (SELECT k, min(levenshtein(c2.name, reg.skill_name)) FILTER (levenshtein(c2.name, reg.skill_name) <= 2) AS distance, max({_jaccard("c2.words", "reg.words")}) AS alike,
  list_sort(list(DISTINCT reg.skill_name) FILTER (levenshtein(c2.name, reg.skill_name) <= 2 OR {_jaccard("c2.words", "reg.words")} > 0.45)) AS neighbours
  FROM c2, reg WHERE c2.name <> reg.skill_name GROUP BY k),
f AS (SELECT c2.*, distance, alike, neighbours, {_hits("flow", R.CONTROL_VERBS)} > 0 AS control, {_hits("flow || ' ' || low", R.WRITE_VERBS)} > 0 AS writes, list_sum([{_DOMAIN}]) AS others,
  scope IN {str(R.SCOPES)} AS known, ({_CALLS}) AS calls, len(regexp_extract_all(body, '\\[\\s*\\]\\s*Step\\s*\\d+')) AS steps FROM c2 JOIN m USING (k)),
g AS (SELECT *, {_case(("distance IS NOT NULL OR alike > 0.45", "1"), ("alike > 0.65", "2"))} AS r1, {_case(("NOT known", "3"), ("known AND others >= 2", "2"), ("known AND others = 1", "1"))} AS r2,
  {_case(("control AND risk <> 'L4'", "3"), (f"control AND risk = 'L4' AND NOT contains(body, '{A.APPROVAL}')", "3"), ("NOT control AND risk = 'L1' AND writes", "2"), ("risk = 'L4' AND NOT control", "1"))} AS r3,
  {_case(("length(trim(description)) < 40", "1"), (f"{_hits('low', TRIGGERS)} = 0", "1"), (f"{_hits('low', R.VAGUE_ROUTING)} > 0", "1"), (f"{_hits('low', A.BROAD)} >= 2", "2"))} AS r4,
  {_case(("calls", "3"), ("NOT calls AND steps <= 2 AND NOT regexp_matches(body, '(?i)error|fail|not found|exception|if .* → |else')", "1"), (f"NOT calls AND {_hits('low', A.CONJUNCTIONS)} > 0", "2"))} AS r5 FROM f)
SELECT k AS c_custkey, name, ({_LEVELS})[r1 + 1] AS global_conflict, ({_LEVELS})[r2 + 1] AS agent_boundary, ({_LEVELS})[r3 + 1] AS risk_level, ({_LEVELS})[r4 + 1] AS routing_governance,
  ({_LEVELS})[r5 + 1] AS form_factor, ({_DECISIONS})[greatest(r1, r2, r3, r4, r5) + 1] AS decision, coalesce(array_to_string(neighbours, ','), '') AS neighbours FROM g""")
def adm01_skill_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.skill_gate(skill_candidates(spark, sf_dir), skill_registry(spark, sf_dir), keep=("c_custkey",)).withColumn("neighbours", F.array_join("neighbours", ",")).drop("reasons")


def tool_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.lower("n_name")
    name = F.when(k % 5 == 0, F.concat(F.lit("read-"), n)).when(k % 5 == 1, F.concat(F.lit("read-"), n, F.lit("-xyz"))).when(k % 5 == 2, F.concat(F.lit("bill-"), k.cast("string"), F.lit("-manager"))).otherwise(F.concat(F.lit("metering-number-"), k.cast("string")))
    x = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.select(
        "s_suppkey", name.alias("tool_name"), F.replace(_pick(TOOL_TEXTS, F.floor(k / 2)), F.lit("{n}"), n).alias("description"), _pick(("Parsing", "execution", "cooking"), k).alias("category"),
        _pick(("ops-tools", "energy-tools", "own-tools", ""), F.floor(k / 3)).alias("service"), _pick(("L0", "l1", "L2", "L3", "L4", "L9"), F.floor(k / 4)).alias("risk_level"),
        _pick(("none", "Read", "read", "write", "external", "none", "read"), F.floor(k / 4)).alias("side_effects"), F.when(k % 4 != 0, k % 4 < 3).alias("idempotent"), F.when(k % 3 != 0, k % 3 == 1).alias("requires_approval"),
        F.slice(F.array(F.lit("a"), F.lit(" "), F.lit("b")), F.lit(1), (k % 4).cast("int")).alias("called_by_skills"), F.slice(F.array(*(F.lit(f) for f in FIELDS)), F.lit(1), (k % 5).cast("int")).alias("input_fields"),
    )


def tool_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.lower("n_name"), F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("read-"), n).alias("tool_name"), F.when(k % 2 == 0, F.concat(F.lit("Reads the meters of "), n, F.lit(" for bills"))).alias("description"), F.concat(F.lit("Reads the meters of "), n).alias("display_name"),
        _pick(("ops-tools", "energy-tools"), k).alias("service"), F.when(k < 2, F.array(F.lit("unit"), F.lit("zone"), F.lit("text"))).alias("input_fields"),
    )


_J = _jaccard("c.words", "reg.words")
_FIELD_JACCARD = _jaccard("c.fields", "reg.fields")


@query(f"""WITH reg AS (SELECT 'read-' || lower(n_name) AS tool_name, {_words("CASE WHEN n_nationkey % 2 = 0 THEN 'Reads the meters of ' || n_name || ' for bills' ELSE 'Reads the meters of ' || n_name END")} AS words,
  (['ops-tools','energy-tools'])[n_nationkey % 2 + 1] AS service, CASE WHEN n_nationkey < 2 THEN ['unit','zone','text'] ELSE [] END AS fields FROM nation),
c0 AS (SELECT s_suppkey AS k, lower(n_name) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT k, CASE k % 5 WHEN 0 THEN 'read-' || n WHEN 1 THEN 'read-' || n || '-xyz' WHEN 2 THEN 'bill-' || k || '-manager' ELSE 'metering-number-' || k END AS tool_name,
  replace(({_list(TOOL_TEXTS)})[(k // 2) % 5 + 1], '{{n}}', n) AS description, {_words(f"replace(({_list(TOOL_TEXTS)})[(k // 2) % 5 + 1], '{{n}}', n)")} AS words, (['parsing','execution','cooking'])[k % 3 + 1] AS category,
  (['ops-tools','energy-tools','own-tools',''])[(k // 3) % 4 + 1] AS service, (['L0','L1','L2','L3','L4','L9'])[(k // 4) % 6 + 1] AS risk, (['none','read','read','write','external','none','read'])[(k // 4) % 7 + 1] AS effects,
  CASE WHEN k % 4 <> 0 THEN k % 4 < 3 END AS idempotent, coalesce(CASE WHEN k % 3 <> 0 THEN k % 3 = 1 END, false) AS approval, ([0, 1, 1, 2])[k % 4 + 1] AS callers, ({_list(FIELDS)})[1:k % 5] AS fields FROM c0),
m AS (SELECT k, min(levenshtein(c.tool_name, reg.tool_name)) FILTER (c.tool_name <> reg.tool_name) AS distance, max({_J}) FILTER (c.tool_name <> reg.tool_name) AS alike,
  max({_J}) FILTER (c.service <> reg.service) AS elsewhere, max({_FIELD_JACCARD}) FILTER (c.tool_name <> reg.tool_name) AS overlap,
  list_sort(list(DISTINCT reg.tool_name) FILTER (c.tool_name <> reg.tool_name AND (levenshtein(c.tool_name, reg.tool_name) <= 4 OR {_J} >= 0.65))) AS neighbours FROM c, reg GROUP BY k),
f AS (SELECT c.*, distance, alike, elsewhere, overlap, neighbours, CASE risk WHEN 'L0' THEN 'none' WHEN 'L1' THEN 'read' WHEN 'L2' THEN 'read' WHEN 'L3' THEN 'write' WHEN 'L4' THEN 'external' END AS wanted,
  len(list_filter({_list(A.ORCHESTRATION)}, lambda p: regexp_matches(lower(description), p))) AS many FROM c JOIN m USING (k)),
g AS (SELECT *, {_case(("distance <= 2", "3"), ("distance <= 4", "1"), ("alike >= 0.65", "2"), ("overlap >= 0.7", "2"))} AS r1, {_case(("service = ''", "3"), (f"service <> '' AND service NOT IN {str(A.SERVICES)}", "1"), ("service <> '' AND elsewhere >= 0.55", "2"))} AS r2,
  {_case(("wanted IS NULL OR effects <> wanted", "3"), ("risk = 'L0' AND NOT coalesce(idempotent, false)", "3"), ("risk = 'L4' AND NOT approval", "3"), ("risk = 'L3' AND NOT approval", "1"), ("risk IN ('L3', 'L4') AND idempotent IS NULL", "1"))} AS r3,
  {_case(("callers = 0", "3"), ("callers = 1", "1"))} AS r4, {_case(("tool_name LIKE '%-manager'", "3"), ("many >= 2", "3"), ("many = 1", "2"), ("length(description) > 250", "1"), (f"category NOT IN {str(R.CATEGORIES)}", "1"))} AS r5 FROM f)
SELECT k AS s_suppkey, tool_name, ({_LEVELS})[r1 + 1] AS duplication, ({_LEVELS})[r2 + 1] AS service, ({_LEVELS})[r3 + 1] AS risk, ({_LEVELS})[r4 + 1] AS reuse, ({_LEVELS})[r5 + 1] AS form,
  ({_DECISIONS})[greatest(r1, r2, r3, r4, r5) + 1] AS decision, coalesce(array_to_string(neighbours, ','), '') AS neighbours FROM g""")
def adm01_tool_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tool_gate(tool_candidates(spark, sf_dir), tool_registry(spark, sf_dir), keep=("s_suppkey",)).withColumn("neighbours", F.array_join("neighbours", ",")).drop("reasons")

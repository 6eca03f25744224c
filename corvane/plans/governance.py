"""Queries of the registry side: rules, scorecards and graph queries over registries derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import rules as R
from ..operators import scorecard as C
from ..sources.sinks import dealt
from .tables import AS_OF, REGISTRY_SQL, skills, table, tools

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _as_of():
    return F.lit(AS_OF).cast("date")


_ACT, _OFF, _PEND = "('approved','restricted')", "('deprecated','retired')", "('draft','submitted','needs_revision')"
_OK = "('draft','submitted','approved','restricted','needs_revision','deprecated','retired')"


@query(f"""WITH {REGISTRY_SQL}, d AS (SELECT a.skill_name, a.dep, b.status AS ds FROM skills a LEFT JOIN skills b ON b.skill_name = a.dep WHERE a.status IN {_ACT}), k AS (SELECT * FROM known WHERE tool_status IN {_OK})
SELECT code, severity, count(*) AS n FROM (
SELECT 'S-STATE-1' AS code, 'CRITICAL' AS severity FROM skills WHERE status NOT IN {_OK}
UNION ALL SELECT 'S-STATE-2', 'HIGH' FROM skills WHERE status IN {_ACT} AND risk_level = 'L4' AND security_review <> 'approved'
UNION ALL SELECT 'S-STATE-3', 'CRITICAL' FROM d WHERE ds IN {_PEND}
UNION ALL SELECT 'S-STATE-4', CASE WHEN ds = 'retired' THEN 'CRITICAL' ELSE 'HIGH' END FROM d WHERE ds IN {_OFF}
UNION ALL SELECT 'S-STATE-5', 'HIGH' FROM d WHERE ds IS NULL
UNION ALL SELECT 'T-STATE-1', 'CRITICAL' FROM tools WHERE status NOT IN {_OK}
UNION ALL SELECT 'T-STATE-2', 'WARNING' FROM k WHERE skill_status = 'retired'
UNION ALL SELECT 'T-STATE-3', 'WARNING' FROM k WHERE skill_status IS NULL
UNION ALL SELECT 'T-STATE-4', CASE WHEN tool_status = 'retired' THEN 'CRITICAL' ELSE 'HIGH' END FROM (SELECT DISTINCT tool_name, tool_status FROM k WHERE tool_status IN {_OFF} AND skill_status IN {_ACT})
) GROUP BY 1, 2""")
def rule_state_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.state_guard(skills(spark, sf_dir), tools(spark, sf_dir)).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {REGISTRY_SQL}, s AS (SELECT *, date_diff('day', last_reviewed, DATE '{AS_OF}') AS d, date_diff('day', created_at, DATE '{AS_OF}') AS a FROM skills)
SELECT skill_name AS asset_name, code FROM (
SELECT skill_name, 'invalid_scope' AS code FROM s WHERE bundle_scope NOT IN ('diagnosis-agent','customer-agent','ops-agent','energy-agent','bpmn-agent','platform')
UNION ALL SELECT skill_name, 'invalid_status' FROM s WHERE status NOT IN {_OK}
UNION ALL SELECT skill_name, 'eval_stale' FROM s WHERE eval_status = 'pending' AND a > 90
UNION ALL SELECT skill_name, 'eval_failing' FROM s WHERE eval_status = 'failing')""")
def rule_s2_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.skill_metadata(skills(spark, sf_dir), _as_of()).select("asset_name", "code")


@query(f"""WITH {REGISTRY_SQL}, s AS (SELECT *, date_diff('day', last_reviewed, DATE '{AS_OF}') AS d FROM skills WHERE status <> 'retired')
SELECT skill_name AS asset_name, code, severity FROM (
SELECT skill_name, 'review_overdue' AS code, 'WARNING' AS severity FROM s WHERE d > 180
UNION ALL SELECT skill_name, 'security_review_overdue', 'CRITICAL' FROM s WHERE risk_level = 'L4' AND security_review = 'pending' AND coalesce(d, 31) > 30
UNION ALL SELECT skill_name, 'deprecated_candidate', 'HIGH' FROM s WHERE eval_status = 'failing' AND d > 90 AND status = 'approved'
UNION ALL SELECT skill_name, 'stale_approved', 'WARNING' FROM s WHERE status = 'approved' AND d > 365)""")
def rule_s4_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.skill_reviews(skills(spark, sf_dir), _as_of()).select("asset_name", "code", "severity")


@query(f"""WITH {REGISTRY_SQL}
SELECT tool_name AS asset_name, code FROM (
SELECT tool_name, 'invalid_category' AS code FROM tools WHERE category NOT IN ('parsing','transformation','validation','execution','retrieval','computation')
UNION ALL SELECT tool_name, 'risk_mismatch' FROM tools WHERE side_effects <> CASE risk_level WHEN 'L0' THEN 'none' WHEN 'L1' THEN 'read' WHEN 'L2' THEN 'read' WHEN 'L3' THEN 'write' ELSE 'external' END
UNION ALL SELECT tool_name, 'invalid_status' FROM tools WHERE status NOT IN {_OK})""")
def rule_t2_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tool_metadata(tools(spark, sf_dir)).select("asset_name", "code")


@query(f"""WITH {REGISTRY_SQL}, t AS (SELECT *, date_diff('day', last_reviewed, DATE '{AS_OF}') AS d FROM tools WHERE status <> 'retired')
SELECT tool_name AS asset_name, code, severity FROM (
SELECT tool_name, 'review_overdue' AS code, 'WARNING' AS severity FROM t WHERE d > 180
UNION ALL SELECT tool_name, 'high_risk_review_overdue', CASE WHEN risk_level = 'L4' THEN 'CRITICAL' ELSE 'HIGH' END FROM t WHERE risk_level IN ('L3','L4') AND d > 60
UNION ALL SELECT tool_name, 'stale_approved', 'WARNING' FROM t WHERE status = 'approved' AND d > 365)""")
def rule_t3_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tool_reviews(tools(spark, sf_dir), _as_of()).select("asset_name", "code", "severity")


@query(f"""WITH {REGISTRY_SQL}, a AS (SELECT tool_name, (SELECT count(*) FROM uses u WHERE u.tool_name = t.tool_name) AS n FROM tools t WHERE status IN {_ACT}), k AS (SELECT * FROM known WHERE tool_status IN {_ACT})
SELECT tool_name AS asset_name, code FROM (SELECT tool_name, 'no_consumers' AS code FROM a WHERE n = 0 UNION ALL SELECT tool_name, 'single_consumer' FROM a WHERE n = 1
UNION ALL SELECT tool_name, 'unknown_consumer' FROM k WHERE skill_status IS NULL UNION ALL SELECT tool_name, 'deprecated_consumer' FROM k WHERE skill_status = 'deprecated')""")
def rule_t4_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tool_consumers(skills(spark, sf_dir), tools(spark, sf_dir)).select("asset_name", "code")


@query(f"WITH {REGISTRY_SQL} SELECT consumer AS asset_name, tool_name AS message FROM known WHERE skill_status IS NOT NULL AND tool_risk > skill_risk")
def rule_x3_risk_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.risk_inheritance(skills(spark, sf_dir), tools(spark, sf_dir)).select("asset_name", "message")


@query(f"WITH {REGISTRY_SQL} SELECT 'missing_in_fs' AS code, skill_name AS asset_name FROM skills WHERE skill_name NOT IN (SELECT 'skill-' || o_custkey FROM orders) UNION ALL SELECT DISTINCT 'missing_in_registry', 'skill-' || (o_custkey + 100) FROM orders WHERE 'skill-' || (o_custkey + 100) NOT IN (SELECT skill_name FROM skills)")
def rule_s1_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = skills(spark, sf_dir), table(spark, sf_dir, "orders")
    have = o.select(F.concat(F.lit("skill-"), F.col("o_custkey").cast("string")).alias("skill_name")).distinct()
    shifted = o.select(F.concat(F.lit("skill-"), (F.col("o_custkey") + 100).cast("string")).alias("skill_name")).distinct()
    a = R.alignment(s, have, "skill", "skill_name", []).filter("code = 'missing_in_fs'")
    return a.unionByName(R.alignment(s, shifted, "skill", "skill_name", []).filter("code = 'missing_in_registry'")).select("code", "asset_name")


@query(f"""WITH {REGISTRY_SQL}, g AS (SELECT u.tool_name, count(*) AS n_consumers, count(*) FILTER (WHERE skill_status IN {_ACT}) AS n_active FROM known u WHERE tool_status IN {_ACT} GROUP BY 1),
z AS (SELECT tool_name, 0 AS n_consumers, 0 AS n_active FROM tools WHERE status IN {_ACT} AND tool_name NOT IN (SELECT tool_name FROM uses))
SELECT tool_name, n_consumers, CASE WHEN n_consumers = 0 THEN 'HIGH' ELSE 'WARNING' END AS severity FROM (SELECT * FROM g UNION ALL SELECT * FROM z) WHERE n_active = 0""")
def gr02_orphan_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.orphan_tools(skills(spark, sf_dir), tools(spark, sf_dir))


@query(f"""WITH {REGISTRY_SQL} SELECT consumer AS skill_name, max(tool_risk) AS max_risk, count(DISTINCT tool_name) AS n_tools, CASE WHEN max(tool_risk) >= 'L3' THEN 'HIGH' ELSE 'WARNING' END AS severity
FROM known WHERE skill_status IS NOT NULL AND tool_risk > skill_risk GROUP BY 1""")
def gr04_high_risk_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.high_risk_chains(skills(spark, sf_dir), tools(spark, sf_dir)).select("skill_name", "max_risk", F.size("tools").cast("bigint").alias("n_tools"), "severity")


@query(f"WITH {REGISTRY_SQL} SELECT tool_name, count(DISTINCT bundle_scope) AS n_bundles FROM known WHERE tool_status IN {_ACT} AND skill_status IN {_ACT} GROUP BY 1 HAVING count(DISTINCT bundle_scope) >= 2")
def agg15_shared_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_tools(skills(spark, sf_dir), tools(spark, sf_dir)).select("tool_name", "n_bundles")


_GRAPH = f"""{REGISTRY_SQL}, e AS (
SELECT 'skill:' || skill_name AS src, 'bundle:' || bundle_scope AS dst, 'in_bundle' AS rel FROM skills
UNION SELECT 'tool:' || tool_name, 'service:' || service, 'belongs_to' FROM tools
UNION SELECT 'skill:' || consumer, 'tool:' || tool_name, 'calls' FROM known WHERE skill_status IS NOT NULL
UNION SELECT 'skill:' || a.skill_name, 'skill:' || a.dep, 'depends_on' FROM skills a JOIN skills b ON b.skill_name = a.dep)"""


@query(f"""WITH {_GRAPH} SELECT rel, count(*) AS n FROM e GROUP BY 1
UNION ALL SELECT 'nodes', (SELECT count(*) FROM skills) + (SELECT count(*) FROM tools) + (SELECT count(DISTINCT bundle_scope) FROM skills) + (SELECT count(DISTINCT service) FROM tools)""")
def gr01_build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = G.build(skills(spark, sf_dir), tools(spark, sf_dir))
    return e.groupBy("rel").agg(F.count("*").alias("n")).unionByName(n.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("rel"), "n"))


@query(f"""WITH {_GRAPH} SELECT dst AS id, src AS affected FROM e WHERE rel IN ('calls', 'depends_on') AND dst IN ('tool:tool-4', 'skill:skill-21')
UNION SELECT src, dst FROM e WHERE rel = 'calls' AND src IN ('tool:tool-4', 'skill:skill-21', 'service:service-1')
UNION SELECT dst, src FROM e WHERE rel = 'belongs_to' AND dst = 'service:service-1'
UNION SELECT b.dst, c.src FROM e b JOIN e c ON c.dst = b.src AND c.rel = 'calls' WHERE b.rel = 'belongs_to' AND b.dst = 'service:service-1'""")
def gr03_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = G.build(skills(spark, sf_dir), tools(spark, sf_dir))
    t = spark.createDataFrame([("tool:tool-4",), ("skill:skill-21",), ("service:service-1",)], "id string")
    return G.blast_radius(e, t).select("id", "affected").distinct()


@query(f"""WITH {_GRAPH} SELECT 'edges' AS figure, (SELECT count(*) FROM e) AS value
UNION ALL SELECT 'skills_without_tools', (SELECT count(*) FROM skills WHERE 'skill:' || skill_name NOT IN (SELECT src FROM e WHERE rel = 'calls'))
UNION ALL SELECT 'tools_without_consumers', (SELECT count(*) FROM tools WHERE 'tool:' || tool_name NOT IN (SELECT dst FROM e WHERE rel = 'calls'))""")
def agg14_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = G.build(skills(spark, sf_dir), tools(spark, sf_dir))
    return G.stats(n, e).filter(F.col("figure").isin("edges", "skills_without_tools", "tools_without_consumers"))


@query(f"""WITH {_GRAPH}, m AS (SELECT (SELECT count(*) FROM skills) + (SELECT count(*) FROM tools) + (SELECT count(DISTINCT bundle_scope) FROM skills) + (SELECT count(DISTINCT service) FROM tools) AS nodes, (SELECT count(*) FROM e) AS edges)
SELECT nodes, edges, round_even(2 * edges / (nodes * (nodes - 1)), 4) AS density, round_even(2 * edges / nodes, 3) AS avg_degree FROM m""")
def gr11_graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.metrics(*G.build(skills(spark, sf_dir), tools(spark, sf_dir)))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey + 3 AS dst FROM part WHERE p_size > 10 UNION SELECT p_partkey + 3, p_partkey FROM part WHERE p_size > 45),
r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def gr06_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    e = p.filter("p_size > 10").select(k.alias("src"), (k + 3).alias("dst")).union(p.filter("p_size > 45").select(k + 3, k))
    return G.reachable(e, spark.range(1, 2).select(F.col("id").alias("node")), 200).select("node")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_size > 15 AND p_partkey + 1 IN (SELECT p_partkey FROM part)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, c) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id""")
def gr11_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("id"))
    e = p.filter("p_size > 15").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst")).join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return G.components(nodes, e.select("src", "dst"))


@query("SELECT s_suppkey AS id, CAST(length(CAST(s_suppkey AS VARCHAR)) - 1 AS INTEGER) AS level FROM supplier")
def gr07_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number needs itself without its last digit: its level is its number of digits less one."""
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return G.levels(t, t.filter("id >= 10").select("id", F.floor(F.col("id") / 10).cast("bigint").alias("needs")))


_NODES = "n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey = 0 THEN 'startEvent' WHEN s_suppkey = 9 THEN 'endEvent' WHEN s_suppkey % 4 = 0 THEN 'exclusiveGateway' ELSE 'task' END AS type FROM supplier)"


@query(f"""WITH RECURSIVE {_NODES}, f AS (SELECT id, id AS s, id + 3 AS t FROM n), fw(x) AS (SELECT id FROM n WHERE type = 'startEvent' UNION SELECT f.t FROM fw JOIN f ON f.s = fw.x), bw(x) AS (SELECT id FROM n WHERE type = 'endEvent' UNION SELECT f.s FROM bw JOIN f ON f.t = bw.x)
SELECT code, count(*) AS n FROM (SELECT 'dangling_reference' AS code FROM f WHERE t NOT IN (SELECT id FROM n)
UNION ALL SELECT 'unreachable' FROM n WHERE id NOT IN (SELECT x FROM fw) UNION ALL SELECT 'dead_end' FROM n WHERE id NOT IN (SELECT x FROM bw)
UNION ALL SELECT 'gateway_with_one_exit' FROM n WHERE type LIKE '%Gateway') GROUP BY 1""")
def gr06_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k == 0, "startEvent").when(k == 9, "endEvent").when(k % 4 == 0, "exclusiveGateway").otherwise("task").alias("type"))
    f = n.select("id", F.col("id").alias("source_ref"), (F.col("id") + 3).alias("target_ref"))
    return G.structure_findings(n, f).groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderpriority AS intent FROM orders GROUP BY ALL), p AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS intent FROM orders WHERE o_orderstatus = 'F'),
g AS (SELECT r.k, round_even(count(p.k) / count(*), 6) AS score, count(*) - count(p.k) AS miss FROM r LEFT JOIN p ON p.k = r.k AND p.intent = r.intent GROUP BY 1)
SELECT k, score, CASE WHEN score < 0.8 THEN miss ELSE 0 END AS n_missing, score < 0.7 AS retry FROM g""")
def gr09_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pairs = lambda d: d.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("intent")).distinct()
    c = G.coverage(pairs(o), pairs(o.filter("o_orderstatus = 'F'")), "k")
    return c.select("k", F.bround("score", 6).alias("score"), F.size("missing").cast("bigint").alias("n_missing"), "retry")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS d, l_returnflag AS rel FROM lineitem),
g AS (SELECT a.s AS a, b.s AS b, count(DISTINCT a.d) AS shared, avg(CASE WHEN a.rel = b.rel THEN 1.0 ELSE 0.0 END) AS agreement FROM e a JOIN e b ON a.d = b.d AND a.s < b.s WHERE a.rel <> 'N' AND b.rel <> 'N' GROUP BY 1, 2)
SELECT a, b, shared, round_even(0.5 / shared + 0.3 * agreement + 0.2, 4) AS score FROM g""")
def gr10_portfolio_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel"))
    e = dealt(e, "dst", "src").distinct()
    return G.portfolio_links(e, F.lit(1.0), membership="N").select("a", "b", "shared", "score")


@query("""SELECT 'not_in_graph' AS gap, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 4000)
UNION ALL SELECT 'single_member_theme', t FROM (SELECT 'r' || (n_nationkey // 3) AS t, count(*) AS c FROM nation GROUP BY 1) WHERE c = 1""")
def gr12_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    used = table(spark, sf_dir, "supplier").filter("s_acctbal < 4000").select(F.col("s_nationkey").alias("n_nationkey")).join(n, "n_nationkey").select(F.col("n_name").alias("id")).distinct()
    return G.gaps(n.select(F.col("n_name").alias("ticker")), used, n.select(F.col("n_name").alias("ticker"), F.concat(F.lit("r"), F.floor(F.col("n_nationkey") / 3).cast("string")).alias("theme")))


_DASH = f"""{REGISTRY_SQL}, s AS (SELECT k.*, coalesce(date_diff('day', last_reviewed, DATE '{AS_OF}'), 99999) > 180 AS stale, CASE WHEN o.k IS NULL THEN NULL WHEN o.n > 15 THEN 'PASS' WHEN o.n > 5 THEN 'WARNING' ELSE 'BLOCKED' END AS overall
FROM skills k LEFT JOIN (SELECT 'skill-' || o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON o.k = k.skill_name),
g AS (SELECT bundle_scope, count(*) AS n, count(*) FILTER (WHERE status IN {_ACT}) AS n_active, count(*) FILTER (WHERE status = 'approved') AS n_approved, count(*) FILTER (WHERE status IN {_OFF}) AS n_off,
count(*) FILTER (WHERE eval_status = 'failing') AS failing, count(*) FILTER (WHERE risk_level = 'L4' AND security_review = 'pending') AS sec, count(*) FILTER (WHERE status IN {_ACT} AND stale) AS n_stale,
count(*) FILTER (WHERE overall = 'BLOCKED') AS ci_blocked FROM s GROUP BY 1),
nt AS (SELECT bundle_scope, count(DISTINCT tool_name) AS n_tools FROM known WHERE bundle_scope IS NOT NULL GROUP BY 1),
x AS (SELECT g.*, coalesce(n_tools, 0) AS n_tools, round_even(n_off / n * 100, 0) AS dp FROM g LEFT JOIN nt USING (bundle_scope)),
y AS (SELECT *, CAST(round_even(greatest(0.0, least(100.0, 100 - 0.5 * dp - least(n_stale / n * 40, 30) - 10 * failing - 15 * ci_blocked - 5 * sec + n_approved / n * 10)), 0) AS INTEGER) AS score FROM x)"""


def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("skill-"), F.col("o_custkey").cast("string")).alias("asset_name")).agg(F.count("*").alias("n"))
    ci = n.select("asset_name", F.when(F.col("n") > 15, "PASS").when(F.col("n") > 5, "WARNING").otherwise("BLOCKED").alias("overall"))
    return C.bundle_dashboard(skills(spark, sf_dir), tools(spark, sf_dir), ci, _as_of())


@query(f"WITH {_DASH} SELECT bundle_scope, n, n_active, n_approved, n_stale, ci_blocked, n_tools, (n // gcd(n, n_tools)) || ':' || (n_tools // gcd(n, n_tools)) AS ratio, dp AS deprecated_pct, score FROM y")
def agg03_bundle_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dashboard(spark, sf_dir).select("bundle_scope", "n", "n_active", "n_approved", "n_stale", "ci_blocked", "n_tools", "ratio", "deprecated_pct", "score")


@query(f"WITH {_DASH} SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_active) AS BIGINT) AS n_active, CAST(round_even(avg(score), 0) AS INTEGER) AS mean_score FROM y")
def agg09_platform_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.platform_rollup(_dashboard(spark, sf_dir)).select("n", "n_active", "mean_score")


@query("""WITH g AS (SELECT o_custkey % 10 AS b, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS dep, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') AS stale, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok FROM orders GROUP BY 1)
SELECT b, CAST(round_even(greatest(0.0, least(100.0, 100 - least(dep / n * 50, 20) - least(stale / n * 40, 25) + ok / n * 5)), 0) AS INTEGER) AS score FROM g""")
def agg07_platform_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("b")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("dep"), F.count_if(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("stale"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"),
    )
    return g.select("b", C.platform_score(F.col("n"), F.col("dep"), F.col("stale"), F.lit(0), F.lit(0), F.col("ok")).alias("score"))


@query(f"""WITH {REGISTRY_SQL}, k AS (SELECT 'skill' AS asset_type, 'invalid_status' AS code, 'WARNING' AS severity FROM skills WHERE status NOT IN {_OK} UNION ALL SELECT 'skill', 'eval_failing', 'HIGH' FROM skills WHERE eval_status = 'failing'
UNION ALL SELECT 'tool', 'invalid_status', 'WARNING' FROM tools WHERE status NOT IN {_OK})
SELECT 'severity' AS "by", severity AS value, count(*) AS n FROM k GROUP BY severity UNION ALL SELECT 'asset_type', asset_type, count(*) FROM k GROUP BY asset_type UNION ALL SELECT 'code', code, count(*) FROM k GROUP BY code UNION ALL SELECT 'severity', 'CRITICAL', 0""")
def agg10_findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.skill_metadata(skills(spark, sf_dir), _as_of()).filter("code in ('invalid_status', 'eval_failing')").unionByName(R.tool_metadata(tools(spark, sf_dir)).filter("code = 'invalid_status'"))
    return C.findings_summary(f)


@query("""SELECT o_custkey AS name, count(*) AS n_checks, (['PASS','PASS_WITH_WARNINGS','WARNING','REQUIRES_REVIEW','REJECT'])[max(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 5 ELSE 1 END)] AS overall FROM orders GROUP BY 1""")
def agg11_worst_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.when(p == "1-URGENT", "REJECT").when(p == "2-HIGH", "REQUIRES_REVIEW").when(p == "3-MEDIUM", "WARNING").when(p == "5-LOW", "PASS").otherwise("ERROR").alias("result"))
    return C.worst_of(r, "name")


@query("SELECT p_brand AS bundle_scope, split_part(p_name, ' ', 1) AS family, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 5")
def agg16_family_overload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("bundle_scope"), F.translate("p_name", " ", "-").alias("skill_name"))
    return C.family_overload(p)


@query("SELECT l_suppkey, count(*) FILTER (WHERE q >= 2) AS n FROM (SELECT l_suppkey, CAST(l_quantity > 25 AS INT) + CAST(l_discount > 0.05 AS INT) + CAST(l_tax > 0.04 AS INT) AS q FROM lineitem) GROUP BY 1")
def rule_k_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(F.count_if(C.at_least([F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04], 2)).alias("n"))


@query("""SELECT c_custkey, substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) AS name, substr(c_name, 1, 3) || repeat('*', length(c_name) - 7) || right(c_name, 4) AS id_number,
substr(c_name, 1, 6) || '******' || right(c_name, 4) AS card, '~¥' || CAST(CAST(floor(c_acctbal / 10000) AS BIGINT) AS VARCHAR) || '万' AS amount, lower(substr(c_name, 1, 1)) || '***@bank.com' AS email FROM customer""")
def mask_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.mask_name(n).alias("name"), X.mask_middle(n, 3, 4).alias("id_number"), X.mask_middle(n, 6, 4, 6).alias("card"), X.mask_amount(F.col("c_acctbal")).alias("amount"), X.mask_email(F.concat(F.lower(n), F.lit("@bank.com"))).alias("email"),
    )


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'allow' WHEN 1 THEN CASE WHEN c_custkey % 5 < 3 THEN 'allow' ELSE 'warn' END WHEN 2 THEN CASE WHEN c_custkey % 5 < 2 THEN 'allow' WHEN c_custkey % 5 = 2 THEN 'warn' ELSE 'mask' END
ELSE CASE WHEN c_custkey % 5 < 2 THEN 'allow' WHEN c_custkey % 5 = 2 THEN 'approve' ELSE 'approve+mask' END END AS verdict, CAST(DATE '2024-02-29' + to_years(CAST(CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 15 END AS INTEGER)) AS DATE) AS keep_until FROM customer""")
def rule_class_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda v: F.element_at(F.array(*(F.lit(x) for x in v)), (k % len(v) + 1).cast("int"))
    cls = pick(("public", "internal", "confidential", "secret"))
    return table(spark, sf_dir, "customer").select("c_custkey", R.class_risk(cls, pick(("L0", "L1", "L2", "L3", "L4"))).alias("verdict"), R.keep_until(cls, F.lit("2024-02-29").cast("date")).alias("keep_until"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 1000 < 100 OR o_orderkey % 5 > 2 OR (o_orderkey % 10) / 10 > 0.5 THEN 'review' ELSE 'approve' END AS decision FROM orders")
def rule_credit_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.credit_decision(F.col("o_totalprice") / 1000 + 500, k % 5, (k % 10) / 10).alias("decision"))


@query("SELECT bundle_scope AS status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 8 IN (0, 2, 5) THEN 'eligible' ELSE (['approved','draft','restricted','deprecated','retired','approved','submitted','bogus'])[c_custkey % 8 + 1] END AS bundle_scope FROM customer) GROUP BY 1")
def flt03_catalog_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = skills(spark, sf_dir)
    return s.groupBy(F.when(F.col("status").isin(*G.ACTIVE), "eligible").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))

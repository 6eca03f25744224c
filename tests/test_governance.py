import pytest
from pyspark.sql import functions as F

from corvane.operators import admission as A
from corvane.operators import changes as H
from corvane.operators import graph as G
from corvane.operators import rules as R
from corvane.operators import scorecard as C
from corvane.operators import similarity as S
from corvane.sources import readers


@pytest.mark.parametrize(("n", "dep", "stale", "fail", "blocked", "sec", "ok", "want"), [(3, 0, 0, 0, 2, 0, 3, 80), (2, 0, 2, 0, 2, 0, 2, 50), (11, 0, 11, 0, 11, 0, 11, 0), (4, 0, 1, 0, 4, 0, 4, 40)])
def test_health_score(spark, n, dep, stale, fail, blocked, sec, ok, want):
    a = [F.lit(x) for x in (n, dep, stale, fail, blocked, sec, ok)]
    assert spark.range(1).select(C.health_score(*a).alias("s")).first().s == want


@pytest.mark.parametrize(("a", "want"), [((43, 0, 25, 0, 0, 35), 81), ((31, 0, 25, 0, 0, 31), 80)])
def test_platform_score(spark, a, want):
    assert spark.range(1).select(C.platform_score(*(F.lit(x) for x in a)).alias("s")).first().s == want


def test_flag_modes(spark):
    f = lambda text: spark.range(1).select(C.flag(F.lit(90), F.lit(5), F.lit(0), text).alias("f")).first().f
    assert f(False) == "OK" and f(True) == "HIGH"


def test_worst_of(spark):
    df = spark.createDataFrame([("a", "PASS"), ("a", "REQUIRES_REVIEW"), ("b", "ERROR"), ("c", "PASS")], "name string, result string")
    assert {r.name: r.overall for r in C.worst_of(df, "name").collect()} == {"a": "REQUIRES_REVIEW", "b": "REJECT", "c": "PASS"}
    assert {r.name: r.overall for r in C.worst_of(df, "name", lenient=True).collect()}["b"] == "PASS"


REGISTRY = """
version: 1
skills:
  - skill_name: log-reader   # note
    purpose: "Reads device logs and finds faults in them"
    status: approved
    risk_level: L1
    bundle_scope: diagnosis-agent
    dependencies: [log-store, ghost]
  - skill_name: log-readers
    purpose: Reads device logs and finds faults in there
    status: approved
    risk_level: L4
    dependencies:
      - log-reader
other: 1
"""


def test_registry_and_guard(spark):
    entries = readers.parse_registry(REGISTRY, "skills")
    assert [e["skill_name"] for e in entries] == ["log-reader", "log-readers"] and entries[1]["dependencies"] == ["log-reader"]
    skills = readers.registry_table(spark, entries, readers.SKILL)
    tools = readers.registry_table(spark, [{"tool_name": "t1", "status": "approved", "risk_level": "L3", "called_by_skills": ["log-reader"]}, {"tool_name": "t2", "status": "retired", "called_by_skills": ["tbd", "log-reader"]}], readers.TOOL)
    codes = sorted((r.asset_name, r.code) for r in R.state_guard(skills, tools).collect())
    assert codes == [("log-reader", "S-STATE-5"), ("log-reader", "S-STATE-5"), ("log-readers", "S-STATE-2"), ("t2", "T-STATE-4")]
    assert R.guard_result(R.state_guard(skills, tools)).first().result == "FAIL"
    assert [r.asset_name for r in R.risk_inheritance(skills, tools).collect()] == ["log-reader"]
    assert [r.code for r in R.skill_overlap(skills).collect()] == ["overlap_candidate"]
    nodes, edges = G.build(skills, tools)
    assert {(r.src, r.rel) for r in edges.collect()} == {("skill:log-reader", "in_bundle"), ("skill:log-reader", "calls"), ("skill:log-readers", "depends_on")}
    assert "digraph" in G.dot(nodes, edges).first().dot


def test_review_ages(spark):
    rows = [("a", "2024-09-02"), ("b", "2024-09-01"), ("c", "bad"), ("d", None)]
    s = readers.registry_table(spark, [{"skill_name": n, "status": "approved", "risk_level": "L1", "last_reviewed": d} for n, d in rows], readers.SKILL)
    assert [r.asset_name for r in R.skill_reviews(s, F.lit("2025-03-01").cast("date")).collect()] == ["b"]  # 181 days, not 180


def test_skill_gate(spark):
    reg = readers.registry_table(spark, [{"skill_name": "device-doctor", "purpose": "Finds the cause of device faults from logs"}, {"skill_name": "power-switch"}], readers.SKILL)
    good = "# Workflow\n[ ] Step 1 read\n[ ] Step 2 look\n[ ] Step 3 report\non error stop"
    cand = spark.createDataFrame(
        [
            ("device-docto", "Finds the cause of device faults from logs", good, "diagnosis-agent", None),
            ("power-switch", "Use when a charger has to restart, as a remote operator asks for it", "# Workflow\n## A\nrestart it\n# End\nelse", "ops-agent", "l2"),
            ("reader", "Use when meters of the night have to be read, one by one", good, "platform", "L1"),
            ("reader", "Use when any and all meters have to be read as well as told", good + "\ninvoke the-skill\n", "nowhere", "L4"),
            (None, None, None, None, None),
        ],
        "name string, description string, body string, bundle_scope string, risk_level string",
    )
    got = [(r.name, r.decision, r.reasons, r.neighbours) for r in A.skill_gate(cand, reg).collect()]
    assert sorted(got) == [
        ("", "REJECT", ["scope_missing", "short_description", "no_trigger", "few_steps"], []),
        ("device-docto", "REQUIRES_REVIEW", ["near_name", "description_overlap", "no_trigger"], ["device-doctor"]),
        ("power-switch", "REJECT", ["control_below_l4"], []),
        ("reader", "PASS", [], []),
        ("reader", "REJECT", ["scope_unknown", "l4_without_control", "too_broad", "calls_skills"], []),
    ]
    rows = {(r.name, r.check): r.result for r in A.check_rows(A.skill_gate(cand.limit(1), reg), "name").collect()}
    assert rows[("device-docto", "global_conflict")] == "REQUIRES_REVIEW" and len(rows) == 5
    assert A.skill_gate(cand.limit(0), reg).count() == 0 and A.skill_gate(cand, reg.limit(0)).count() == 5


def test_tool_gate(spark):
    tool = "tool_name string, description string, category string, service string, risk_level string, side_effects string, idempotent boolean, requires_approval boolean, called_by_skills array<string>, input_fields array<string>"
    cand = spark.createDataFrame(
        [
            ("pay-manager", "manages a pipeline", "execution", "pay", "L3", "read", None, None, ["a", " "], ["x"]),
            ("parse-meter", "Parses the text of one meter reading", "parsing", "ops-tools", "L0", "none", True, None, ["a", "b"], ["text", "unit", "zone"]),
            ("read-meter-z", None, None, None, None, None, None, None, None, None),
        ],
        tool,
    )
    reg = spark.createDataFrame([("pay-manage", None, "Pay", "pay", None), ("parse-meter", "Parses the text of one meter reading", None, "bpmn-tools", None), ("cut-meter", "Cuts", None, "ops-tools", ["text", "unit", "zone"])], "tool_name string, description string, display_name string, service string, input_fields array<string>")
    got = {r.tool_name: (r.decision, r.reasons, r.neighbours) for r in A.tool_gate(cand, reg).collect()}
    assert got["pay-manager"] == ("REJECT", ["same_name", "service_unknown", "effects_mismatch", "l3_without_approval", "idempotence_undeclared", "one_caller", "role_name", "orchestration"], ["pay-manage"])
    assert got["parse-meter"] == ("REQUIRES_REVIEW", ["field_overlap", "like_elsewhere"], [])
    assert got["read-meter-z"] == ("REJECT", ["service_missing", "risk_unknown", "no_callers", "category_unknown"], [])


def test_near_names_equal_brute_force(spark):
    names = ["alpha", "alpho", "alphabet", "beta", "bet", "be", "a", "gamma-tool", "gamma-tols"]
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    for most in (2, 4):
        want = {(a, b, lev(a, b)) for a in names for b in names if a != b and lev(a, b) <= most}
        assert {tuple(r) for r in S.near_names(df, df, "name", most).collect()} == want


def test_structure(spark):
    n = spark.createDataFrame([("s", "startEvent"), ("g", "exclusiveGateway"), ("t", "task"), ("e", "endEvent"), ("o", "task"), ("t", "task")], "id string, type string")
    f = spark.createDataFrame([("1", "s", "g"), ("2", "g", "t"), ("3", "t", "g"), ("4", "t", "e"), ("5", "t", "x")], "id string, source_ref string, target_ref string")
    got = {(r.code, r.id) for r in G.structure_findings(n, f).collect()}
    assert got == {("dangling_reference", "5"), ("duplicate_id", "t"), ("unreachable", "o"), ("dead_end", "o"), ("gateway_with_one_exit", "g")}


def test_levels_leave_cycles_out(spark):
    t = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    r = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "id string, needs string")
    assert {x.id: x.level for x in G.levels(t, r).collect()} == {"a": 0, "b": 1, "c": 2}


def test_trigger_risk_and_regulatory(spark):
    d = spark.createDataFrame([("跨境转账",), ("反洗钱",), ("none",)], "t string").select(R.trigger_risk(F.col("t")).alias("r")).collect()
    assert [x.r for x in d] == ["L5", "L2", None]
    p = spark.createDataFrame([("p", "", True, False, True, True, None, False, None, False, None)], "name string, data_class string, customer_data boolean, consent boolean, funds boolean, aml_step boolean, retention int, cross_border boolean, approved boolean, credit_decision boolean, rationale string")
    assert sorted(r.code for r in R.regulatory(p).collect()) == ["R1", "R2", "R4"]


def test_levels_of_a_long_chain(spark):
    n = 70
    t = spark.range(n).select(F.col("id").cast("string").alias("id"))
    r = spark.range(1, n).select(F.col("id").cast("string").alias("id"), (F.col("id") - 1).cast("string").alias("needs"))
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "id string, needs string")
    got = {x.id: x.level for x in G.levels(t.union(loop.select("id")), r.union(loop)).collect()}
    assert got == {str(k): k for k in range(n)}


def test_impact_report_and_spoken_segments(spark):
    radius = spark.createDataFrame([("a", "ops"), ("b", "ops"), ("c", None)], "skill_name string, bundle_scope string")
    assert H.impact_report(radius).splitlines()[2:] == ["| (dependent) | 1 | c |", "| ops | 2 | a, b |"]
    text = "one two three four five " * 12 + "x" * 250
    parts = spark.createDataFrame([(text,)], "t string").select(H.spoken_segments(F.col("t")).alias("p")).first().p
    assert max(map(len, parts)) <= 100 and "".join(parts).replace(" ", "") == text.replace(" ", "")
    actors = spark.createDataFrame([("human",), ("system",), ("automated",), (None,)], "a string")
    assert [r.t for r in actors.select(H.task_type(F.col("a")).alias("t")).collect()] == ["userTask", "serviceTask", "scriptTask", "manualTask"]


def test_pairs_of_a_graph_are_dealt_by_their_number(spark, monkeypatch):
    """Edges are few where pairs are many: places follow the pairs."""
    monkeypatch.setattr(G, "PAIRS", 10, raising=False)
    edges = spark.range(60).selectExpr("id as src", "id % 3 as dst", "'r' as rel")
    links = G.portfolio_links(edges, F.lit(1.0))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "60), REPARTITION_BY_NUM" in plan  # 3 neighbours of 20 * 20 / 2 pairs
    assert links.count() == 3 * 20 * 19 // 2

"""Asset graph: nodes and edges as two tables, and the queries over them."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ACTIVE = ("approved", "restricted")
RISKS = ("L0", "L1", "L2", "L3", "L4", "L5")


def risk_rank(risk: Column, default: str = "L1") -> Column:
    return F.array_position(F.array(*(F.lit(r) for r in RISKS)), F.coalesce(risk, F.lit(default)))


def build(skills: DataFrame, tools: DataFrame, inline: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, type, name, risk_level, status; edges: src, dst, rel)."""
    node = lambda kind, name: F.concat(F.lit(f"{kind}:"), name)
    plain = F.lit(None).cast("string")
    s = skills.select(node("skill", F.col("skill_name")).alias("id"), F.lit("skill").alias("type"), F.col("skill_name").alias("name"), "risk_level", "status")
    t = tools.select(node("tool", F.col("tool_name")).alias("id"), F.lit("tool").alias("type"), F.col("tool_name").alias("name"), "risk_level", "status")
    named = lambda df, c, kind: df.select(F.col(c).alias("name")).filter("name <> ''").distinct().select(node(kind, F.col("name")).alias("id"), F.lit(kind).alias("type"), "name", plain.alias("risk_level"), plain.alias("status"))
    nodes = reduce(DataFrame.unionByName, [s, t, named(skills, "bundle_scope", "bundle"), named(tools, "service", "service")])
    edge = lambda df, a, b, rel: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("rel"))
    calls = tools.select("tool_name", F.explode("called_by_skills").alias("c")).join(skills.select(F.col("skill_name").alias("c")), "c")
    deps = skills.select("skill_name", F.explode("dependencies").alias("d")).join(skills.select(F.col("skill_name").alias("d")), "d")
    edges = [
        edge(skills.filter("bundle_scope <> ''"), node("skill", F.col("skill_name")), node("bundle", F.col("bundle_scope")), "in_bundle"),
        edge(tools.filter("service <> ''"), node("tool", F.col("tool_name")), node("service", F.col("service")), "belongs_to"),
        edge(calls, node("skill", F.col("c")), node("tool", F.col("tool_name")), "calls"),
        edge(deps, node("skill", F.col("skill_name")), node("skill", F.col("d")), "depends_on"),
    ]
    if inline is not None:
        edges.append(edge(inline, node("skill", F.col("skill_name")), node("tool", F.col("tool_name")), "calls_inline"))
    return nodes, reduce(DataFrame.unionByName, edges).dropDuplicates(["src", "dst", "rel"])


def inline_calls(bodies: DataFrame, tools: DataFrame) -> DataFrame:
    """(skill_name, tool_name) of `server:tool()` in skill texts."""
    found = bodies.select("skill_name", F.explode(F.regexp_extract_all("body", F.lit(r"[a-z][a-z0-9-]+:([a-z][a-z0-9_]+)\(\)"), F.lit(1))).alias("call"))
    return found.join(tools.select("tool_name", F.translate("tool_name", "-", "_").alias("call")), "call").select("skill_name", "tool_name").distinct()


def consumers(skills: DataFrame, tools: DataFrame) -> DataFrame:
    """tool_name, consumer and, where it is known, its status, bundle and risk."""
    uses = tools.select("tool_name", F.col("status").alias("tool_status"), F.col("risk_level").alias("tool_risk"), F.explode_outer("called_by_skills").alias("consumer"))
    s = skills.select(F.col("skill_name").alias("consumer"), F.col("status").alias("skill_status"), F.col("bundle_scope"), F.col("risk_level").alias("skill_risk"))
    return uses.join(s, "consumer", "left")


def orphan_tools(skills: DataFrame, tools: DataFrame) -> DataFrame:
    """Active tools without an active consumer: HIGH if nobody calls them, else WARNING."""
    x = consumers(skills, tools).filter(F.col("tool_status").isin(*ACTIVE))
    g = x.groupBy("tool_name").agg(F.count("consumer").alias("n_consumers"), F.count_if(F.col("skill_status").isin(*ACTIVE)).alias("n_active"))
    return g.filter("n_active = 0").select("tool_name", "n_consumers", F.when(F.col("n_consumers") == 0, "HIGH").otherwise("WARNING").alias("severity"))


def blast_radius(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, affected, via) one step from each target id: who calls a tool, who depends on a skill and what it calls,
    and for a service its tools and their callers."""
    t = targets.select("id").distinct()
    back = edges.filter(F.col("rel").isin("calls", "calls_inline", "depends_on")).join(t.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.col("src").alias("affected"), F.col("rel").alias("via"))
    out = edges.filter(F.col("rel").isin("calls", "calls_inline")).join(t.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("id"), F.col("dst").alias("affected"), F.col("rel").alias("via"))
    own = edges.filter("rel = 'belongs_to'").join(t.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.col("src").alias("affected"), F.col("rel").alias("via"))
    callers = own.select("id", F.col("affected").alias("dst")).join(edges.filter(F.col("rel").isin("calls", "calls_inline")), "dst").select("id", F.col("src").alias("affected"), F.col("rel").alias("via"))
    return reduce(DataFrame.unionByName, [back, out, own, callers]).distinct()


def reachable(edges: DataFrame, starts: DataFrame, most_steps: int) -> DataFrame:
    """(node, depth) of all nodes reached within so many steps, by frontiers; the shortest depth counts. Cycles are no problem."""
    from ..sources.sinks import cut

    seen = cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for step in range(1, most_steps + 1):
        nxt = frontier.select(F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("node")).distinct()
        nxt = cut(nxt.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)))
        if nxt.isEmpty():
            break
        seen, frontier = cut(seen.unionByName(nxt)), nxt
    return seen


def _followed(single: DataFrame) -> DataFrame:
    """(node, up): the first node before each of `single` (node, up: its one predecessor) that isn't one of them, by doubling; rows
    of a cycle of such nodes, and behind one, are left out."""
    from ..sources.sinks import kept

    up = kept(single)
    for _ in range(up.count().bit_length() + 1):
        further = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
        up = kept(up.join(further, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            break
        up = up.drop("moved")
    return up.select("node", "up").join(single.select(F.col("node").alias("up")), "up", "left_anti")


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node) of all nodes that ways from the starts lead to, themselves included.

    A node with a single predecessor that is no start is reached just when that one is: such chains are contracted, in as many rounds as
    their length has binary digits, until there are none; only what is left goes step by step, and the chains are unfolded."""
    from ..sources.sinks import kept

    start = kept(starts.select("node").distinct())
    e = kept(edges.select("src", "dst").dropna().filter("src <> dst").distinct())
    chains = []
    while True:
        before = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("up"))
        single = kept(before.filter("n = 1").select("node", "up").join(start, "node", "left_anti"))
        if single.isEmpty():
            break
        follow = kept(_followed(single))
        rest = e.join(single.select(F.col("node").alias("dst")), "dst", "left_anti").join(single.select(F.col("node").alias("src"), F.lit(True).alias("own")), "src", "left")
        rest = rest.join(follow.select(F.col("node").alias("src"), "up"), "src", "left").filter("own is null or up is not null")
        e = kept(rest.select(F.coalesce("up", "src").alias("src"), "dst").filter("src <> dst").distinct())
        chains.append(follow)
    seen = frontier = start
    while True:
        step = frontier.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct()
        frontier = kept(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = kept(seen.unionByName(frontier))
    for follow in reversed(chains):
        seen = kept(seen.unionByName(follow.join(seen.select(F.col("node").alias("up")), "up", "left_semi").select("node")))
    return seen


def high_risk_chains(skills: DataFrame, tools: DataFrame, default: str = "L1") -> DataFrame:
    """Skills that call tools of higher risk: the tools, the highest rank, HIGH from L3 on."""
    x = consumers(skills, tools).filter("skill_status is not null")
    gap = x.filter(risk_rank(F.col("tool_risk"), default) > risk_rank(F.col("skill_risk"), default))
    g = gap.groupBy(F.col("consumer").alias("skill_name"), "skill_risk").agg(F.sort_array(F.collect_set("tool_name")).alias("tools"), F.max("tool_risk").alias("max_risk"))
    return g.withColumn("severity", F.when(risk_rank(F.col("max_risk")) >= 4, "HIGH").otherwise("WARNING"))


def shared_tools(skills: DataFrame, tools: DataFrame, least: int = 2) -> DataFrame:
    x = consumers(skills, tools).filter(F.col("tool_status").isin(*ACTIVE) & F.col("skill_status").isin(*ACTIVE))
    g = x.groupBy("tool_name").agg(F.count_distinct("bundle_scope").alias("n_bundles"), F.sort_array(F.collect_set("bundle_scope")).alias("bundles"))
    return g.filter(F.col("n_bundles") >= least).withColumn("note", F.col("n_bundles") >= 3)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per figure: node and edge counts, by kind too, skills without tools, tools without callers."""
    calls = edges.filter(F.col("rel").isin("calls", "calls_inline"))
    idle = nodes.filter("type = 'skill'").join(calls.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    unused = nodes.filter("type = 'tool'").join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    fig = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("figure"), "value")
    by_type = nodes.groupBy(F.concat(F.lit("nodes:"), "type").alias("figure")).agg(F.count("*").alias("value"))
    by_rel = edges.groupBy(F.concat(F.lit("edges:"), "rel").alias("figure")).agg(F.count("*").alias("value"))
    return reduce(DataFrame.unionByName, [fig(nodes, "nodes"), fig(edges, "edges"), by_type, by_rel, fig(idle, "skills_without_tools"), fig(unused, "tools_without_consumers")])


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, density 2E / (n (n - 1)) and average degree."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    x = n.join(e, F.lit(True))
    return x.withColumn("density", F.bround(2 * F.col("edges") / F.greatest(F.col("nodes") * (F.col("nodes") - 1), F.lit(1)), 4)).withColumn("avg_degree", F.bround(2 * F.col("edges") / F.greatest(F.col("nodes"), F.lit(1)), 3))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id that undirected edges reach, by passing labels and jumping over known ones."""
    from ..sources.sinks import cut

    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(nodes.select("id", F.col("id").alias("component")))
    for _ in range(most_rounds):
        around = both.join(label.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("low"))
        nxt = label.join(around, "id", "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("further"))
        nxt = cut(nxt.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component")))
        if nxt.join(label.withColumnRenamed("component", "old"), "id").filter("component <> old").isEmpty():
            return nxt
        label = nxt
    raise RuntimeError("components aren't settled")


def levels(tasks: DataFrame, requires: DataFrame) -> DataFrame:
    """(id, level): the longest path from a task without preconditions; tasks of one level may run in parallel. Rows of a
    cycle get no level."""
    from ..sources.sinks import cut

    done = cut(tasks.select("id").join(requires.select("id").distinct(), "id", "left_anti").withColumn("level", F.lit(0)))
    for step in itertools.count(1):
        open_ = tasks.select("id").join(done, "id", "left_anti")
        waiting = requires.join(done.select(F.col("id").alias("needs")), "needs", "left_anti").select("id").distinct()
        ready = cut(open_.join(waiting, "id", "left_anti").withColumn("level", F.lit(step)))
        if ready.isEmpty():
            break
        done = cut(done.unionByName(ready))
    return done


def structure_findings(nodes: DataFrame, flows: DataFrame, strict: bool = False) -> DataFrame:
    """Process graph checks: no start or end, dangling references, duplicate ids, unreachable or dead-end nodes, gateways with one exit."""
    fin = lambda df, code, sev="error": df.select(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.col("id"))
    has = lambda kind: nodes.filter(F.col("type") == kind)
    spark = nodes.sparkSession
    one = spark.range(1).select(F.lit("process").alias("id"))
    ids = nodes.select("id").distinct()
    dangling = flows.select(F.col("id").alias("flow"), F.explode(F.array("source_ref", "target_ref")).alias("id")).join(ids, "id", "left_anti").select(F.col("flow").alias("id")).distinct()
    twice = nodes.groupBy("id").count().filter("count > 1").select("id")
    edges = flows.select(F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"))
    forward = reached(edges, has("startEvent").select(F.col("id").alias("node")))
    backward = reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), has("endEvent").select(F.col("id").alias("node")))
    orphan = ids.join(forward.select(F.col("node").alias("id")), "id", "left_anti")
    dead = ids.join(backward.select(F.col("node").alias("id")), "id", "left_anti")
    exits = flows.groupBy(F.col("source_ref").alias("id")).agg(F.count("*").alias("n"))
    lone = nodes.filter(F.col("type").endswith("Gateway")).select("id").join(exits, "id", "left").filter(F.coalesce("n", F.lit(0)) < 2)
    missing = lambda kind: one.join(has(kind).limit(1).select(F.lit("process").alias("id")), "id", "left_anti")
    parts = [
        fin(missing("startEvent"), "no_start"), fin(missing("endEvent"), "no_end"), fin(dangling, "dangling_reference"), fin(twice, "duplicate_id"),
        fin(orphan, "unreachable"), fin(dead, "dead_end"), fin(lone, "gateway_with_one_exit", "error" if strict else "warning"),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Edges of a neighbour that one part holds.
HUB = 500
#: Pairs of edges that one place makes.
PAIRS = 2_000_000


def portfolio_links(edges: DataFrame, fresh: Column, membership: str = "member_of") -> DataFrame:
    """Pairs that share a neighbour: 0.5 non-obviousness + 0.3 agreement + 0.2 freshness. Non-obviousness is 1 - shared
    themes' share, agreement the share of equal relations; both are our reading of the scores' names."""
    from ..sources.sinks import kept

    e = edges.filter(F.col("rel") != membership).select("src", "dst", "rel", fresh.alias("fresh"))
    # One edge of each source and neighbour counts them as shared: no distinct count, so pairs add up before the shuffle.
    e = kept(e.withColumn("one", (F.row_number().over(W.partitionBy("dst", "src").orderBy("rel")) == 1).cast("int")))
    # A neighbour of many sources is dealt to cells of two parts of them, so that no task holds all its pairs.
    loads = e.groupBy("dst").agg(F.count("*").alias("_n"))
    # Cells are dealt by the pairs they make, of which there are many more than edges.
    pairs = loads.agg(F.sum(F.col("_n") * F.col("_n") / 2)).first()[0] or 0
    places = max(math.ceil(pairs / PAIRS), e.sparkSession.sparkContext.defaultParallelism)
    e = e.join(loads.select("dst", F.ceil(F.col("_n") / HUB).alias("_parts")), "dst").withColumn("_part", F.pmod(F.xxhash64("src"), F.col("_parts")))
    ends = F.col("_part"), F.sequence(F.col("_part"), F.col("_parts") - 1), F.sequence(F.lit(0).cast("bigint"), F.col("_part"))
    one, two = e.withColumn("_i", ends[0]).withColumn("_j", F.explode(ends[1])), e.withColumn("_j", ends[0]).withColumn("_i", F.explode(ends[2]))
    a, b = (df.select(F.col("src").alias(x), "dst", "_i", "_j", *(F.col(c).alias(f"{c}_{x}") for c in ("rel", "fresh", "one"))).repartition(places, "dst", "_i", "_j") for df, x in ((one, "a"), (two, "b")))
    equal = F.avg((F.col("rel_a") == F.col("rel_b")).cast("double"))
    pairs = a.join(b, ["dst", "_i", "_j"]).filter("_i < _j and a <> b or a < b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    g = pairs.groupBy("a", "b").agg(F.sum(F.col("one_a") * F.col("one_b")).alias("shared"), equal.alias("agreement"), F.avg((F.col("fresh_a") + F.col("fresh_b")) / 2).alias("freshness"))
    g = g.withColumn("non_obviousness", 1 / F.col("shared"))
    return g.withColumn("score", F.bround(0.5 * F.col("non_obviousness") + 0.3 * F.col("agreement") + 0.2 * F.col("freshness"), 4))


def gaps(universe: DataFrame, nodes: DataFrame, themes: DataFrame) -> DataFrame:
    """Tickers that the graph lacks, and themes with a single member."""
    lacking = universe.join(nodes.select(F.col("id").alias("ticker")), "ticker", "left_anti").select(F.lit("not_in_graph").alias("gap"), F.col("ticker").alias("name"))
    thin = themes.groupBy("theme").agg(F.count_distinct("ticker").alias("n")).filter("n = 1").select(F.lit("single_member_theme").alias("gap"), F.col("theme").alias("name"))
    return lacking.unionByName(thin)


def coverage(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Share of the required intents that are present per key; below 0.8 the missing ones, below 0.7 a retry."""
    x = required.join(present.select(key, "intent", F.lit(1).alias("_has")).distinct(), [key, "intent"], "left")
    g = x.groupBy(key).agg(F.avg(F.coalesce("_has", F.lit(0)).cast("double")).alias("score"), F.sort_array(F.collect_set(F.when(F.col("_has").isNull(), F.col("intent")))).alias("missing"))
    return g.select(key, "score", F.when(F.col("score") < 0.8, F.col("missing")).otherwise(F.array().cast("array<string>")).alias("missing"), (F.col("score") < 0.7).alias("retry"))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One text: the graph in DOT, clusters by kind, colour by risk; in_bundle edges left out."""
    colour = F.element_at(F.create_map(*(x for r, c in zip(RISKS, ("gray", "green", "blue", "orange", "red", "purple"), strict=True) for x in (F.lit(r), F.lit(c)))), F.coalesce("risk_level", F.lit("L0")))
    n = nodes.select("type", F.format_string('    "%s" [label="%s", color=%s];', "id", "name", colour).alias("line"))
    clusters = n.groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body")).select(F.format_string('  subgraph "cluster_%s" {\n%s\n  }', "type", "body").alias("line"))
    e = edges.filter("rel <> 'in_bundle'").select(F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", "rel").alias("line"))
    every = clusters.select(F.lit(0).alias("o"), "line").unionByName(e.select(F.lit(1).alias("o"), "line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda p: p["line"])
    return every.agg(F.concat(F.lit("digraph assets {\n"), F.array_join(lines, "\n"), F.lit("\n}")).alias("dot"))

"""Cycles and gateways of process graphs: strongly connected components, loop_back edges, levels, fork-join checks.

All of it works on tables of nodes and edges by rounds of joins in which only what changed moves on; lineage is cut by
written tables. Ids are of any one type that has an order; graphs of many processes are one table when ids are unique over
them. Edges from or to unknown nodes are left out; repeated edges count once.

Where nodes and edges name their process, each process of at most SMALL rows is one row that a task solves by itself, after one
shuffle; larger ones go by the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.sinks import kept


#: Nodes and edges of a process that one task solves as a row.
SMALL = 500


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) between nodes."""
    ids = nodes.select("id").distinct()
    e = edges.select("src", "dst").distinct()
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _spread(labels: DataFrame, edges: DataFrame, step: int = 0, within: DataFrame | None = None) -> DataFrame:
    """(id, label): the largest label that reaches each node along edges, each edge adding `step`. Semi-naive: only labels
    that grew are sent on."""
    labels = changed = kept(labels)
    while True:
        sent = changed.select(F.col("id").alias("src"), "label").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.max("label").alias("came"))
        came = F.col("came") + step if step else F.col("came")
        changed = kept(sent.join(labels, "id").filter(came > F.col("label")).select("id", came.alias("label")))
        if changed.isEmpty():
            return labels
        labels = kept(labels.join(changed.withColumnRenamed("label", "grown"), "id", "left").select("id", F.coalesce("grown", "label").alias("label")))


def _trimmed(live: DataFrame) -> DataFrame:
    """Edges between nodes that have both an edge in and an edge out; the others are on no cycle."""
    while True:
        both = live.select(F.col("src").alias("id")).intersect(live.select(F.col("dst").alias("id")))
        left = kept(live.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        if left.count() == live.count():
            return left
        live = left


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the largest id of the node's strongly connected component.

    Nodes on no cycle are trimmed first. Then rounds of colouring: the largest id that reaches a node is its colour, and the nodes of a colour
    that reach back to the node of that id are its component. Each round settles one component a colour at least."""
    found = kept(nodes.select("id").distinct().withColumn("component", F.col("id")))
    live = _trimmed(kept(known_edges(nodes, edges).filter("src <> dst")))
    while not live.isEmpty():
        ids = live.select(F.col("src").alias("id")).distinct()
        colour = _spread(ids.withColumn("label", F.col("id")), live)
        alike = live.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b")
        back = kept(alike.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = _reached(colour.filter("id = label").select("id"), back)
        settled = kept(colour.join(reached, "id").select("id", F.col("label").alias("set")))
        found = kept(found.join(settled, "id", "left").select("id", F.coalesce("set", "component").alias("component")))
        rest = live.join(settled.select(F.col("id").alias("src")), "src", "left_anti").join(settled.select(F.col("id").alias("dst")), "dst", "left_anti")
        live = _trimmed(kept(rest))
    return found


def _reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    seen = frontier = kept(starts.select("id").distinct())
    while True:
        step = frontier.withColumnRenamed("id", "src").join(edges, "src").select(F.col("dst").alias("id")).distinct()
        frontier = kept(step.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = kept(seen.unionByName(frontier))


def typed_edges(nodes: DataFrame, edges: DataFrame, condition: Column | None = None) -> DataFrame:
    """src, dst, type of distinct edges: loop_back, conditional or sequence. nodes: id, place (order of the steps).

    An edge within a strongly connected component that doesn't lead to a later place is loop_back (equal places go by id);
    without these the graph has no cycle, as all other edges of a component lead on. Of repeated edges one
    with a condition makes it conditional."""
    about = nodes.join(strong_components(nodes, edges), "id").select("id", "place", "component")
    conditional = F.coalesce(condition, F.lit("")) != "" if condition is not None else F.lit(False)
    e = edges.withColumn("_c", conditional).groupBy("src", "dst").agg(F.max("_c").alias("conditional"))
    x = e.join(about.select(*(F.col(c).alias(f"{c}_src" if c != "id" else "src") for c in about.columns)), "src").join(about.select(*(F.col(c).alias(f"{c}_dst" if c != "id" else "dst") for c in about.columns)), "dst")
    later = F.struct("place_dst", "dst") > F.struct("place_src", "src")
    return x.select("src", "dst", F.when((F.col("component_src") == F.col("component_dst")) & ~later, "loop_back").when(F.col("conditional"), "conditional").otherwise("sequence").alias("type"))


def ordered_levels(nodes: DataFrame, typed: DataFrame) -> DataFrame:
    """(id, level) of every node: the longest way to it without loop_back edges. Nodes of one level depend on none of each other."""
    start = nodes.select("id").distinct().withColumn("label", F.lit(0).cast("bigint"))
    return _spread(start, kept(typed.filter("type <> 'loop_back'").select("src", "dst")), 1).withColumnRenamed("label", "level")


def parallel_groups(levels: DataFrame, process: str) -> DataFrame:
    """levels with parallel_group: the level where two or more nodes of a process share it, else null."""
    n = levels.groupBy(process, "level").agg(F.count("*").alias("_n"))
    return levels.join(n, [process, "level"]).withColumn("parallel_group", F.when(F.col("_n") > 1, F.col("level"))).drop("_n")


def gatherings(starts: DataFrame, edges: DataFrame, levels: DataFrame, forward: bool = True) -> DataFrame:
    """(start, meets): the first node that all ways from `start` (starts: id) lead through, null where there is none before the
    end: its immediate post-dominator; with forward=False its immediate dominator, over ways backwards.

    A token stands on each node that a start's ways have come to; those of the lowest level move on, so the tokens of a
    start always cut all its ways. When one token is left, all ways meet there. The work is the size of the region between a
    node and where its ways meet, whatever the rest of the graph."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    height = F.col("level") if forward else -F.col("level")
    step = kept(edges.select(F.col(a).alias("node"), F.col(b).alias("next")))
    high = kept(levels.select(F.col("id").alias("node"), height.alias("h")))
    # A way that ends stands on no node, above all others.
    tokens = starts.select(F.col("id").alias("start")).distinct().join(step.withColumnRenamed("node", "start"), "start", "left").select("start", F.col("next").alias("node")).distinct()
    tokens = kept(tokens.join(high, "node", "left").select("start", "node", "h"))
    met = []
    while True:
        each = tokens.groupBy("start").agg(F.min("h").alias("low"), F.min("node").alias("n1"), F.max("node").alias("n2"), F.count_if(F.col("node").isNull()).alias("ended"))
        each = kept(each.withColumn("met", F.col("n1").isNull() | (F.col("n1") == F.col("n2")) & (F.col("ended") == 0)))
        met.append(each.filter("met").select("start", F.col("n1").alias("meets")))
        open_ = tokens.join(each.filter("not met").select("start", "low"), "start")
        stay = open_.filter("h is null or h > low").select("start", "node", "h")
        move = open_.filter("h = low").join(step, "node", "left").select("start", F.col("next").alias("node")).distinct().join(high, "node", "left").select("start", "node", "h")
        tokens = kept(stay.unionByName(move).distinct())
        if tokens.isEmpty():
            return reduce(DataFrame.unionByName, met)


def _in_processes(nodes: DataFrame, edges: DataFrame, process: str, kind: str | None, solve: Callable, schema: str, rounds: Callable) -> DataFrame:
    """solve(place, kinds, edges) of each small process, which gives rows of the schema, and rounds(nodes, edges) of all others."""
    x = nodes.select(process, "id", "place", F.col(kind).alias("kind") if kind else F.lit(None).cast("string").alias("kind"), F.lit(None).cast(nodes.schema["id"].dataType).alias("dst"))
    e = edges.select(process, F.col("src").alias("id"), F.lit(None).cast(nodes.schema["place"].dataType).alias("place"), F.lit(None).cast("string").alias("kind"), "dst")
    rows = kept(x.unionByName(e))
    large = kept(rows.groupBy(process).agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select(process))
    some = not large.isEmpty()
    small = rows.join(large, process, "left_anti") if some else rows
    packed = small.groupBy(process).agg(F.collect_list(F.struct("id", "place", "kind", "dst")).alias("rows")).select("rows")  # at most SMALL a row
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            ids, places, kinds, ends = (flat.field(k).to_pylist() for k in range(4))
            at = lists.offsets.to_pylist()
            found = []
            for lo, hi in zip(at, at[1:], strict=False):
                lo, hi = lo - at[0], hi - at[0]
                place = {ids[k]: places[k] for k in range(lo, hi) if ends[k] is None and places[k] is not None}
                ways = {(ids[k], ends[k]) for k in range(lo, hi) if ends[k] is not None and ids[k] in place and ends[k] in place}
                found += solve(place, [(ids[k], kinds[k]) for k in range(lo, hi) if ends[k] is None], ways)
            columns = zip(*found, strict=True) if found else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    out = packed.mapInArrow(run, struct)
    if not some:
        return out
    return out.unionByName(rounds(nodes.join(large, process, "left_semi"), edges.join(large, process, "left_semi").select("src", "dst")))


def _next(pairs) -> dict:
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


def _loops_of(place: dict, ways: set) -> set:
    """The edges that lead back, to where their own source is reached from."""
    out, loops = _next(ways), set()
    for a, b in ways:
        if (place[b], b) > (place[a], a):
            continue
        seen, todo = {b}, [b]
        while todo and a not in seen:
            new = [y for y in out.get(todo.pop(), ()) if y not in seen]
            seen.update(new)
            todo += new
        if a in seen:
            loops.add((a, b))
    return loops


def _levels_of(place: dict, ahead: set) -> dict:
    out, open_ = _next(ahead), dict.fromkeys(place, 0)
    for _, b in ahead:
        open_[b] += 1
    level = dict.fromkeys(place, 0)
    todo = [i for i, n in open_.items() if not n]
    while todo:
        a = todo.pop()
        for b in out.get(a, ()):
            level[b] = max(level[b], level[a] + 1)
            open_[b] -= 1
            if not open_[b]:
                todo.append(b)
    return level


def _levels_and_loops(place: dict, kinds: list, ways: set) -> list:
    loops = _loops_of(place, ways)
    level, n = _levels_of(place, ways - loops), dict.fromkeys(place, 0)
    for a, _ in loops:
        n[a] += 1
    return [(i, level[i], n[i]) for i in place]


def _meeting(start, step: dict, height: dict):
    """As `gatherings`, for one start."""
    tokens = set(step.get(start, (None,)))
    while True:
        if len(tokens) == 1:
            return next(iter(tokens))
        low = min(height[x] for x in tokens if x is not None)
        move = {x for x in tokens if x is not None and height[x] == low}
        tokens -= move
        for x in move:
            tokens.update(step.get(x, (None,)))


def _findings_of(place: dict, kinds: list, ways: set) -> list:
    ahead = ways - _loops_of(place, ways)
    level = _levels_of(place, ahead)
    on, back = _next(ahead), _next((b, a) for a, b in ahead)
    of = lambda kind, some: {i for i, t in kinds if t == kind and len(some.get(i, ())) > 1}
    forks, choices, joins = of("parallelGateway", on), of("exclusiveGateway", on), of("parallelGateway", back)
    meets = {i: _meeting(i, on, level) for i in forks | choices}
    parts = {i: _meeting(i, back, {k: -v for k, v in level.items()}) for i in joins}
    open_ = {i for i in forks if meets[i] is None or parts.get(meets[i]) != i}
    shut = {i for i, m in parts.items() if m in choices} | {meets[i] for i in choices if meets[i] in joins}
    return [("LOGIC_004", "error", i) for i in open_] + [("LOGIC_005", "error", i) for i in shut]


def levels_and_loops(nodes: DataFrame, edges: DataFrame, process: str | None = None) -> DataFrame:
    """id, level, n_loops of every node: as `ordered_levels`, and how many loop_back edges leave it. process: a column of both tables;
    edges stay within a process."""
    if process is not None:
        kind = nodes.schema["id"].dataType.simpleString()
        return _in_processes(nodes, edges, process, None, _levels_and_loops, f"id {kind}, level bigint, n_loops bigint", levels_and_loops)
    typed = kept(typed_edges(nodes, edges))
    loops = typed.filter("type = 'loop_back'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_loops"))
    return ordered_levels(nodes, typed).join(loops, "id", "left").select("id", "level", F.coalesce("n_loops", F.lit(0)).cast("bigint").alias("n_loops"))


def gateway_findings(nodes: DataFrame, edges: DataFrame, process: str | None = None) -> DataFrame:
    """code, severity, id of process graphs (nodes: id, type, place; edges: src, dst), loop_back edges left out.

    LOGIC_004: a parallel gateway with several ways on has a matching join if all its ways first meet at a parallel gateway, and all ways
    to that one come from it. LOGIC_005: a parallel gateway waits for several ways of which an exclusive gateway takes one only:
    the ways that meet in it part at an exclusive gateway, or all ways of an exclusive gateway first meet in it.

    process: a column of both tables; edges stay within a process."""
    if process is not None:
        kind = nodes.schema["id"].dataType.simpleString()
        return _in_processes(nodes, edges, process, "type", _findings_of, f"code string, severity string, id {kind}", gateway_findings)
    typed = typed_edges(nodes, edges)
    levels = ordered_levels(nodes, typed)
    ahead = kept(typed.filter("type <> 'loop_back'").select("src", "dst"))
    out = ahead.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id")
    into = ahead.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id")
    of = lambda kind, some: nodes.filter(F.col("type") == kind).select("id").distinct().join(some, "id", "left_semi")
    forks, choices, joins = kept(of("parallelGateway", out)), kept(of("exclusiveGateway", out)), kept(of("parallelGateway", into))
    meets = kept(gatherings(forks.unionByName(choices), ahead, levels))
    parts = kept(gatherings(joins, ahead, levels, forward=False))
    matched = meets.join(parts.select(F.col("start").alias("meets"), F.col("meets").alias("start")), ["start", "meets"], "left_semi").select(F.col("start").alias("id"))
    open_forks = forks.join(matched, "id", "left_anti")
    apart = parts.join(choices.select(F.col("id").alias("meets")), "meets", "left_semi").select(F.col("start").alias("id"))
    shut = meets.join(choices.select(F.col("id").alias("start")), "start", "left_semi").select(F.col("meets").alias("id")).join(joins, "id", "left_semi")
    finding = lambda df, code: df.distinct().select(F.lit(code).alias("code"), F.lit("error").alias("severity"), "id")
    return finding(open_forks, "LOGIC_004").unionByName(finding(apart.unionByName(shut), "LOGIC_005"))

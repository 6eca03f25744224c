"""Cycles, levels and gateways of process graphs against plain versions."""

import random

import pytest

from corvane.operators import cycles as C
from corvane.operators import graph as G


def edges_of(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")


def nodes_of(spark, ids, kinds=None, places=None):
    return spark.createDataFrame([(str(i), (kinds or {}).get(i, "task"), (places or {}).get(i, k)) for k, i in enumerate(ids)], "id string, type string, place int")


def reach(ids, pairs, without=None):
    out = {i: {i} for i in ids if i != without}
    for i in out:
        stack = [i]
        while stack:
            x = stack.pop()
            for a, b in pairs:
                if a == x and b != without and b in out and b not in out[i]:
                    out[i].add(b)
                    stack.append(b)
    return out


def plain_components(ids, pairs):
    r = reach(ids, pairs)
    return {i: max((j for j in ids if j in r[i] and i in r[j]), key=str) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_components_and_loops_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = list(range(10, 26))
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(16 + 5 * seed)] + [(10, 10), (11, 12), (11, 12), (11, 99)]
    known = [(a, b) for a, b in pairs if a in ids and b in ids]
    nodes = nodes_of(spark, ids)
    want = plain_components(ids, known)
    assert {r.id: r.component for r in C.strong_components(nodes, edges_of(spark, pairs)).collect()} == {str(i): str(c) for i, c in want.items()}
    typed = C.typed_edges(nodes, edges_of(spark, pairs))
    loops = {(str(a), str(b)) for a, b in known if want[a] == want[b] and b <= a}
    assert {(r.src, r.dst) for r in typed.filter("type = 'loop_back'").collect()} == loops
    ahead = {(a, b) for a, b in known if (str(a), str(b)) not in loops}
    level = {}

    def height(i):
        if i not in level:
            level[i] = max((height(a) + 1 for a, b in ahead if b == i), default=0)
        return level[i]

    assert {r.id: r.level for r in C.ordered_levels(nodes, typed).collect()} == {str(i): height(i) for i in ids}


def test_edge_types_and_groups(spark):
    nodes = nodes_of(spark, ["a", "b", "c", "d"])
    edges = spark.createDataFrame([("a", "b", "x > 1"), ("a", "b", None), ("a", "c", ""), ("b", "d", None), ("c", "d", None), ("d", "a", "again")], "src string, dst string, condition string")
    typed = C.typed_edges(nodes, edges, edges["condition"])
    assert {(r.src, r.dst): r.type for r in typed.collect()} == {("a", "b"): "conditional", ("a", "c"): "sequence", ("b", "d"): "sequence", ("c", "d"): "sequence", ("d", "a"): "loop_back"}
    levels = C.ordered_levels(nodes, typed).selectExpr("*", "'p' AS process")
    assert {r.id: (r.level, r.parallel_group) for r in C.parallel_groups(levels, "process").collect()} == {"a": (0, None), "b": (1, 1), "c": (1, 1), "d": (2, None)}


def plain_meets(ids, pairs, start, ends):
    """The nearest node without which no end is reached, None if that is no node."""
    r = reach(ids, pairs)
    must = [m for m in ids if m != start and m in r[start] and not (reach(ids, pairs, m)[start] & ends)]
    return next((m for m in must if all(o == m or o not in reach(ids, pairs, m)[start] for o in must)), None)


@pytest.mark.parametrize("seed", range(2))
def test_gatherings_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = list(range(100, 112))
    pairs = sorted({(a, min(a + rng.randint(1, 4), 111)) for a in ids for _ in range(2) if a < 111})
    if seed % 2:
        pairs = [p for p in pairs if p[0] != 105]  # a way that ends early
    nodes, edges = nodes_of(spark, ids), edges_of(spark, pairs)
    levels = C.ordered_levels(nodes, C.typed_edges(nodes, edges))
    for forward in (True, False):
        ways = pairs if forward else [(b, a) for a, b in pairs]
        ends = {i for i in ids if not any(a == i for a, _ in ways)}
        got = {r.start: r.meets for r in C.gatherings(nodes.select("id"), edges, levels, forward).collect()}
        assert got == {str(i): (lambda m: None if m is None else str(m))(plain_meets(ids, ways, i, ends)) if i not in ends else None for i in ids}


P, X = "parallelGateway", "exclusiveGateway"
PLAIN = [("s", "f"), ("f", "t1"), ("f", "t2"), ("t1", "j"), ("t2", "j"), ("j", "e")]
LEAVES = [("s", "f"), ("f", "t1"), ("f", "t2"), ("f", "t3"), ("t1", "j"), ("t2", "j"), ("t3", "e"), ("j", "e")]
CHOICE = [("s", "f"), ("f", "t1"), ("f", "x"), ("x", "a"), ("x", "b"), ("a", "j"), ("b", "j"), ("t1", "j"), ("j", "e")]
MERGED = [("s", "f"), ("f", "t1"), ("f", "x"), ("x", "a"), ("x", "b"), ("a", "m"), ("b", "m"), ("m", "j"), ("t1", "j"), ("j", "e")]
NESTED = [("s", "f"), ("f", "g"), ("f", "t1"), ("g", "a"), ("g", "b"), ("a", "k"), ("b", "k"), ("k", "j"), ("t1", "j"), ("j", "e")]
LOOP = [("s", "f"), ("f", "t1"), ("f", "t2"), ("t1", "j"), ("t2", "j"), ("j", "x"), ("x", "f"), ("x", "y"), ("y", "e")]
#: Kinds of the gateways, ways, and what is found.
CASES = [
    ({"f": P, "j": P}, PLAIN, set()), ({"f": X, "j": X}, PLAIN, set()), ({"f": P, "j": X}, PLAIN, {("LOGIC_004", "f")}), ({"f": X, "j": P}, PLAIN, {("LOGIC_005", "j")}),
    ({"f": P, "j": P}, LEAVES, {("LOGIC_004", "f")}), ({"f": X, "j": P}, LEAVES, {("LOGIC_005", "j")}), ({"f": P, "j": P, "x": X}, CHOICE, {("LOGIC_005", "j")}),
    ({"f": P, "j": P, "x": X, "m": X}, MERGED, set()), ({"f": P, "j": P, "g": P, "k": P}, NESTED, set()), ({"f": P, "j": P, "g": P, "k": X}, NESTED, {("LOGIC_004", "g")}),
    ({"f": P, "j": P, "x": X}, LOOP, set()),
]


def test_gateways_of_many_processes(spark):
    """All cases are processes of one table, a loop among them."""
    nodes, ways, want = [], [], set()
    for n, (kinds, pairs, found) in enumerate(CASES):
        order = list(dict.fromkeys(x for p in pairs for x in p))
        nodes += [(f"{n}/{x}", kinds.get(x, "task"), k) for k, x in enumerate(order)]
        ways += [(f"{n}/{a}", f"{n}/{b}") for a, b in pairs]
        want |= {(code, f"{n}/{x}") for code, x in found}
    got = C.gateway_findings(spark.createDataFrame(nodes, "id string, type string, place int"), edges_of(spark, ways))
    assert {(r.code, r.id) for r in got.collect()} == want


def test_empty_graph(spark):
    nodes, edges = nodes_of(spark, []), edges_of(spark, [])
    assert C.gateway_findings(nodes, edges).isEmpty()
    assert C.ordered_levels(nodes_of(spark, ["a"]), C.typed_edges(nodes, edges)).collect() == [("a", 0)]


def test_reached_of_long_chains_in_few_rounds(spark, monkeypatch):
    """Chains, a cycle that nothing leads to, one behind a start, joins of chains, a start within a chain."""
    from corvane.sources import sinks

    written = []
    keep = sinks.kept
    monkeypatch.setattr(sinks, "kept", lambda df, *more: written.append(1) or keep(df, *more))
    pairs = [(i, i + 3) for i in range(300)] + [(900, 901), (901, 902), (902, 900), (902, 903), (0, 500), (500, 501), (501, 502), (502, 500), (502, 502), (297, 600), (501, 600), (600, 601), (120, 7)]
    ids = {x for p in pairs for x in p} | {1000}
    for starts in ([0], [100, 1000], []):
        r = reach(ids, pairs)
        written.clear()
        got = G.reached(edges_of(spark, pairs), spark.createDataFrame([(str(i),) for i in starts], "node string"))
        assert {x.node for x in got.collect()} == {str(x) for i in starts for x in r[i]}
        assert len(written) < 60


@pytest.mark.parametrize("small", [500, 15])
def test_processes_are_solved_alike_in_a_row_and_by_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL", small)
    nodes, ways, want = [], [], set()
    for n, (kinds, pairs, found) in enumerate(CASES):
        order = list(dict.fromkeys(x for p in pairs for x in p))
        nodes += [(f"{n}/{x}", kinds.get(x, "task"), k, n) for k, x in enumerate(order)]
        ways += [(f"{n}/{a}", f"{n}/{b}", n) for a, b in pairs + pairs[:1] + [(pairs[0][0], "unknown")]]
        want |= {(code, f"{n}/{x}") for code, x in found}
    nodes = spark.createDataFrame(nodes, "id string, type string, place int, p int")
    ways = spark.createDataFrame(ways, "src string, dst string, p int")
    assert {(r.code, r.id) for r in C.gateway_findings(nodes, ways, "p").collect()} == want
    got = {tuple(r) for r in C.levels_and_loops(nodes, ways, "p").collect()}
    typed = C.typed_edges(nodes, ways)
    loops = [r.src for r in typed.filter("type = 'loop_back'").collect()]
    assert got == {(r.id, r.level, loops.count(r.id)) for r in C.ordered_levels(nodes, typed).collect()}

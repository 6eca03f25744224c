"""Text search, vector search, fusion and template match against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corvane.operators import docs as D
from corvane.operators import search as S
from corvane.operators import seams
from corvane.operators import templates as TM
from corvane.operators import vectors as V

DOCS = "id bigint, text string, score string, term int"


def plain_bm25(docs, queries, k):
    words = lambda t: [w for w in re.findall(r"\w+", (t or "").lower()) if len(w) >= 3]
    bag = defaultdict(Counter)
    for i, t in docs:
        if i is not None:
            bag[i].update(words(t))
    n, mean = len(bag), sum(sum(b.values()) for b in bag.values()) / max(len(bag), 1)
    df = Counter(w for b in bag.values() for w in b)
    out = []
    for q in {q for q, _ in queries}:
        asked = {w for x, t in queries if x == q for w in words(t)}
        score = Counter()
        for i, b in bag.items():
            for w in asked & set(b):
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                score[i] += math.floor(1_000_000 * idf * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)))
        best = sorted((i for i in score), key=lambda i, score=score: (-score[i], i))[:k]
        out += [(q, r + 1, i, score[i]) for r, i in enumerate(best)]
    return sorted(out)


def corpus(n, seed=1):
    rng = random.Random(seed)
    pool = ["the", "und", "über", "of", *(f"word{k}" for k in range(40))]
    weight = [30, 25, 20, 30, *(40 / (k + 1) for k in range(40))]
    return [(i, " ".join(rng.choices(pool, weight, k=rng.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("lead", [0.0, 0.6])
def test_search_is_exact_however_much_is_read_first(spark, monkeypatch, lead):
    monkeypatch.setattr(S, "PART", 7)  # lists of frequent words are dealt over many parts
    docs = corpus(120) + [(7, "word1 word1"), (None, "word1"), (500, None), (501, ""), (502, "word9"), (503, "word9")]
    queries = [(1, "word1 the of"), (2, "WORD9, word30"), (3, "nothing known"), (4, None), (5, "the the und of über"), (5, "word17"), (None, "the"), (6, "word39 word38 word37 the of und")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    index = S.build_index(frame, "id", "text")
    got = S.search(index, spark.createDataFrame(queries, "query_id bigint, text string"), 5, lead)
    assert sorted(tuple(r) for r in got.collect()) == plain_bm25(docs, [q for q in queries if q[0] is not None], 5)
    assert index.table("terms").agg({"parts": "max"}).first()[0] > 3


def test_search_of_empty_tables(spark):
    index = S.build_index(spark.createDataFrame([], DOCS), "id", "text")
    assert S.search(index, spark.createDataFrame([(1, "word")], "query_id bigint, text string")).isEmpty()
    index = S.build_index(spark.createDataFrame([(1, "word", "", 1)], DOCS), "id", "text")
    assert S.search(index, spark.createDataFrame([], "query_id bigint, text string")).isEmpty()


def test_sums_are_made_where_a_document_is(spark, monkeypatch):
    """Pairs of a query and a document aren't shuffled: no task holds those of all documents. Places grow with the postings read."""
    monkeypatch.setattr(S, "MEETINGS", 50)
    index = S.build_index(spark.createDataFrame([(*d, "x", 1) for d in corpus(120)], DOCS), "id", "text")
    asked = spark.createDataFrame([(q, t) for q in range(5) for t in ("the", "of", "word1")], "query_id bigint, term string").join(index.table("terms"), "term")
    sums = S._sums(S.kept(asked), index)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan
    read = asked.agg({"df": "sum"}).first()[0]
    assert "hashpartitioning(id" in plan and f", {-(-read // 50)})" in plan


def test_an_index_keeps_its_postings_once(spark, tmp_path):
    S.build_index(spark.createDataFrame([(*d, "x", 1) for d in corpus(30)], DOCS), "id", "text", str(tmp_path / "index"))
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["documents", "figures", "postings", "terms"]


def test_fusion_keeps_its_evidence(spark):
    schema = "query_id int, rank int, id int"
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 10), (1, 5, 10)], schema)
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], schema)
    got = {(r.query_id, r.id): (r.rank, r.score, [tuple(e) for e in r.evidence]) for r in S.fuse({"a": a, "b": b}, 2, weights={"b": 3}).collect()}
    unit = lambda r: 10**9 // (60 + r)
    assert got == {
        (1, 11): (1, unit(2) + 3 * unit(1), [("a", 2), ("b", 1)]),
        (1, 12): (2, 3 * unit(2), [("b", 2)]),
        (2, 10): (1, unit(1), [("a", 1)]),
    }


VECTORS = "id bigint, embedding array<float>, cell int"


def plain_nearest(rows, queries, k):
    unit = lambda v: np.array(np.float32(v), float) / np.linalg.norm(np.array(np.float32(v), float))
    able = [(i, unit(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in queries:
        if v and any(v):
            s = sorted((-round(float(unit(v) @ w), 9), i) for i, w in able)[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_ivf_exact_and_probed(spark, monkeypatch):
    monkeypatch.setattr(V, "PART", 40)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 8)) * 4
    rows = [(i, [float(x) for x in np.float32(centers[i % 12] + rng.normal(size=8))]) for i in range(600)]
    odd = [(None, [1.0] * 8), (900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] * 4)]
    frame = spark.createDataFrame([(*r, 5) for r in rows + odd + rows[:3]], VECTORS)
    index = V.build_ivf(frame, "id", "embedding", cells=12, sample=200)
    assert index.table("vectors").count() == 603  # a sample fits the cells, all rows are in them
    queries = [(i, rows[i * 7][1]) for i in range(40)] + [(100, [0.0] * 8), (101, None)]
    q = spark.createDataFrame(queries, "query_id bigint, embedding array<float>")
    want = plain_nearest(rows + odd + rows[:3], queries, 10)
    exact = V.nearest_exact(index, q, 10, probes=2)
    assert sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in exact.collect()) == want
    probes = V.probes_for(index, q.filter("query_id % 2 = 1"), 10, 0.95)
    assert 1 <= probes < 12
    probed = V.probe(index, q, 10, probes)
    r = V.recall(probed, exact).collect()
    assert len(r) == 40 and sum(x.found for x in r) >= 0.9 * sum(x.wanted for x in r)
    assert sorted((x.query_id, x["rank"], x.id, round(x.score, 9)) for x in V.probe(index, q, 10, probes=12).collect()) == want
    few = V.nearest_exact(V.build_ivf(frame.limit(3), "id", "embedding"), q, 10)
    assert few.groupBy("query_id").count().filter("count <> 3").isEmpty()


def test_scored_pairs_stay_in_their_task(spark, monkeypatch):
    """Where no bound cuts, what leaves a task is k rows of a query and block, not a row for each pair."""
    monkeypatch.setattr(V, "VECTORS", 100)
    monkeypatch.setattr(V, "QUERIES", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=16))]) for i in range(800)]
    index = V.build_ivf(spark.createDataFrame([(*r, 5) for r in rows], VECTORS), "id", "embedding", cells=4)
    q = V._units(spark.createDataFrame(rows[:50], "query_id bigint, embedding array<float>"))
    n = V._scored(index, q, 3, 4).count()
    blocks = 8 + index.table("vectors").rdd.getNumPartitions()
    assert 150 <= n <= 50 * 3 * blocks < 50 * 800


def test_ivf_of_nothing(spark):
    index = V.build_ivf(spark.createDataFrame([], VECTORS), "id", "embedding")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    assert V.nearest_exact(index, q).isEmpty() and V.probe(index, q).isEmpty()


def plain_templates(requests, templates, k):
    t, r = defaultdict(set), defaultdict(set)
    for i, x in templates:
        if i is not None and x is not None:
            t[i].add(x)
    for i, x in requests:
        if i is not None and x is not None:
            r[i].add(x)
    df = Counter(x for s in t.values() for x in s)
    w = lambda x: math.floor(1_000_000 * (1 + math.log(len(t) / df.get(x, 1))))
    out = []
    for q, asked in r.items():
        score = {i: math.floor(1_000_000 * sum(map(w, asked & s)) / sum(map(w, asked | s))) for i, s in t.items() if asked & s}
        out += [(q, n + 1, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i, score=score: (-score[i], i))[:k])]
    return sorted(out)


@pytest.mark.parametrize("lead", [0.1, 0.5])
def test_template_match(spark, lead):
    rng = random.Random(3)
    pick = lambda n: [f"i{min(int(rng.expovariate(0.3)), 14)}" for _ in range(n)]
    templates = [(i, x) for i in range(40) for x in pick(rng.randint(1, 6))] + [(None, "i1"), (3, None)]
    requests = [(i, x) for i in range(60) for x in pick(rng.randint(1, 5))] + [(70, "unknown"), (71, "unknown"), (71, "i0"), (None, "i0"), (72, None)]
    r, t = spark.createDataFrame(requests, "request_id int, intent string"), spark.createDataFrame(templates, "template_id int, intent string")
    m = TM.match_templates(r, t, 3, lead)
    want = plain_templates(requests, templates, 3)
    assert sorted(tuple(x) for x in m.collect()) == want
    best = {x.request_id: (x.template_id, x.band) for x in TM.best_match(r.dropna(), m).collect()}
    top = {q: (i, s) for q, n, i, s in want if n == 1}
    assert best == {q: (top[q][0], "shortcut" if top[q][1] >= 800_000 else "hint") if q in top and top[q][1] >= 500_000 else (None, "none") for q in {q for q, x in requests if q is not None and x is not None}}


def test_template_match_by_blocks_and_equal_sets(spark, monkeypatch):
    for name, n in (("REQUESTS", 5), ("TEMPLATES", 4), ("SLICE", 3)):
        monkeypatch.setattr(TM, name, n)
    templates = [(i, x) for i in range(40) for x in (("a", "b"), ("b",), ("c", "d", "e"), ("a", "e"))[i % 4]]
    requests = [(i, x) for i in range(90) for x in (("a",), ("b", "c"), ("e", "z"), ("a", "b", "c", "d", "e"), ("z",))[i % 5]]
    r, t = spark.createDataFrame(requests, "request_id int, intent string"), spark.createDataFrame(templates, "template_id int, intent string")
    assert sorted(tuple(x) for x in TM.match_templates(r, t, 3).collect()) == plain_templates(requests, templates, 3)
    assert TM.match_templates(r.limit(0), t).isEmpty() and TM.match_templates(r, t.limit(0)).isEmpty()


def tree_block(sets, weights):
    """What a task gets of templates: (ids, set of codes) each."""
    kind = pa.struct([("codes", pa.binary()), ("ws", pa.binary()), ("total", pa.int64()), ("keys", pa.list_(pa.int64()))])
    as_bytes = lambda xs, n: b"".join(x.to_bytes(n, "big") for x in xs)
    return pa.array([{"codes": as_bytes(sorted(s), 4), "ws": as_bytes([weights[c] for c in sorted(s)], 8), "total": sum(weights[c] for c in s), "keys": ids} for ids, s in sets], kind)


@pytest.mark.parametrize(("nodes", "found", "cells"), [(131_072, 1_000_000, 2_000_000), (7, 5, 60)])
def test_template_tree_looks_at_few_nodes(monkeypatch, nodes, found, cells):
    for name, n in (("NODES", nodes), ("FOUND", found), ("CELLS", cells)):
        monkeypatch.setattr(TM, name, n)
    rng = random.Random(5)
    weights = {c: 1_000_000 + 70_000 * (30 - c) for c in range(1, 26)}
    many, asks = (6000, 200) if cells > 60 else (150, 40)
    sets = list({frozenset(rng.sample(range(1, 26), rng.randint(1, 8))) for _ in range(many)})
    templates = [(sorted(rng.sample(range(10 * i, 10 * i + 10), rng.randint(1, 3))), s) for i, s in enumerate(sets)]
    requests = [sorted(rng.sample(range(1, 29), rng.randint(1, 10))) for _ in range(asks)]  # 26 to 28 are in no template
    total = np.array([sum(weights.get(c, 3_000_000) for c in q) for q in requests], np.float64)
    trees = [TM._Tree(tree_block(part, weights)) for part in ((templates,) if cells > 60 else (templates[:50], templates[50:]))]
    got, floor = defaultdict(list), np.full(asks, -1.0)
    for tree in trees:
        for who, place, score in tree.best(np.concatenate(requests), np.array([len(q) for q in requests]), total, floor, 3, 2048):
            for q, i, x in zip(who.tolist(), tree.ids.take(pa.array(tree.by_place[place])).to_pylist(), score.tolist(), strict=True):
                got[q].append((-x, i))
    for n, q in enumerate(requests):
        shared = [(ids, sum(weights[c] for c in s & set(q)), sum(weights[c] for c in s)) for ids, s in templates]
        want = sorted((-math.floor(1_000_000 * x / (int(total[n]) + size - x)), i) for ids, x, size in shared if x for i in ids)[:3]
        assert sorted(got[n])[:3] == want
    if cells > 60:
        assert trees[0].looked < 0.4 * len(sets) * asks


def test_template_match_unknown_and_text_ids(spark, monkeypatch):
    for name, n in (("REQUESTS", 7), ("TEMPLATES", 6), ("CODES", 11)):
        monkeypatch.setattr(TM, name, n)
    rng = random.Random(9)
    pick = lambda n, m: {f"i{rng.randint(0, m)}" for _ in range(n)}
    templates = [(f"t{i % 50:02}", x) for i in range(60) for x in pick(rng.randint(1, 7), 12)]
    requests = [(f"r{i}", x) for i in range(120) for x in [*pick(rng.randint(1, 9), 16), *pick(2, 16)]] + [("lost", None), (None, "i1"), ("far", "z1"), ("far", "z2"), ("far", "z1")]
    rng.shuffle(requests)
    r, t = spark.createDataFrame(requests, "request_id string, intent string"), spark.createDataFrame(templates, "template_id string, intent string")
    assert sorted(tuple(x) for x in TM.match_templates(r, t, 3).collect()) == plain_templates(requests, templates, 3)


def test_band_requests_reads_requests_once(spark):
    rng = random.Random(11)
    templates = [(i, f"i{rng.randint(0, 9)}") for i in range(30) for _ in range(3)]
    requests = [(i, f"i{rng.randint(0, 11)}") for i in range(80) for _ in range(rng.randint(1, 4))] + [(90, None), (91, "z"), (None, "i1"), (5, None)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    r, t = spark.createDataFrame(requests, "request_id int, intent string"), spark.createDataFrame(templates, "template_id int, intent string")
    got = TM.band_requests(r.mapInArrow(count, r.schema), t).collect()
    assert seen.value == len(requests)
    assert sorted(map(str, got)) == sorted(map(str, TM.best_match(r, TM.match_templates(r, t)).collect()))


def test_references_match_short_names(spark):
    refs = spark.createDataFrame([("see 手册 now",), ("xxabxx",), ("a",), ("zz",), (" ",), ("a b c",)], "ref string")
    known = spark.createDataFrame([("手册",), ("ab",), ("A",), ("",), ("abc",)], "doc_name string")
    got = {r.ref: (r.doc_name, r.level) for r in D.match_references(refs, known).collect()}
    assert got == {"see 手册 now": ("手册", 2), "xxabxx": ("ab", 2), "a": ("A", 1), "a b c": ("A", 2)}


def test_embedding_tries_three_times(spark, tmp_path):
    marker = str(tmp_path / "calls")

    def model(texts):
        with open(marker, "a") as f:
            f.write("x")
        if len(open(marker).read()) < 3:
            raise OSError("busy")
        return [[1.0, 2.0] for _ in texts]

    df = spark.createDataFrame([(1, "a")], "k int, t string").coalesce(1)
    assert seams.embed(df, "t", model, dimension=2).first().failed is False

    def broken(texts):
        raise OSError("down")

    row = seams.embed(df, "t", broken, dimension=2, attempts=2).first()
    assert row.failed and list(row.embedding) == [0.0, 0.0]

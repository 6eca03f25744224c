import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import linededup, oracles, queries

SCHEMA = "doc_id bigint, text string, gone string, key int, _a string"
SPACES = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def plain(held, rows, least, chars=1):
    """(doc_id, n_lines, n_dropped, kept) of rows, as the documents in held say."""
    n = Counter(k for i, t in set(held) for k in {key_of(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < chars or n[key_of(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def reported(index, spark, rows, **kw):
    return Counter(tuple(r) for r in index.report(frame(spark, rows), **kw).collect())


def some(rng, n, first=0):
    pool = [" Shared Line ", "shared line", "SHARED LINE\t", "", "  ", "Ünïcode Ä", "ünïcode ä", "漢字", "a", "é", *(f"line {k}" for k in range(12))]
    return [(first + i, "\n".join(rng.choice(pool, rng.integers(1, 9)))) for i in range(n)]


ODD = [(None, None), (None, ""), (900, None), (901, ""), (902, "\n\n"), (903, "a\r\na\r\n"), (904, "x " * 40_000 + "\nshared line"), (905, "shared line"), (905, "shared line"), (905, "shared line\na"), (None, "shared line")]


def test_index_follows_insertions_and_deletions(spark):
    rng = np.random.default_rng(3)
    first, second = some(rng, 60) + ODD, some(rng, 40, 100)
    one = linededup.LineIndex.create(spark, least_docs=6).insert(frame(spark, first))
    assert reported(one, spark, first, inserted=True) == plain(first, first, 6)
    assert reported(one, spark, second) == plain(first, second, 6)  # documents that the index doesn't hold
    two = one.insert(frame(spark, second))
    everything = first + second
    assert reported(two, spark, everything, inserted=True) == plain(everything, everything, 6)
    again = two.insert(frame(spark, second + second))  # a batch that comes again changes nothing
    assert again.counts().exceptAll(two.counts()).isEmpty() and two.counts().exceptAll(again.counts()).isEmpty()
    ids = [i for i, _ in first][:50] + [None, 5, 5, 77777]
    three = linededup.LineIndex.open(spark, again.path).delete(spark.createDataFrame([(i,) for i in ids], "doc_id bigint"))
    left = [r for r in everything if r[0] not in ids]
    assert reported(three, spark, everything) == plain(left, everything, 6)
    four = three.insert(frame(spark, first))
    assert reported(four, spark, everything) == plain(everything, everything, 6)
    assert reported(one, spark, second) == plain(first, second, 6)  # earlier versions stay as they were
    gone = four.delete(four.documents().select("doc_id"))
    assert gone.counts().isEmpty() and reported(gone, spark, everything) == plain([], everything, 6)


def test_filters_hold_the_frequent_keys(spark, monkeypatch):
    """After a build, after changes, and after a filter that was full is built anew."""
    texts = [(i, "\n".join(f"common {k}" for k in range(i % 3 * 4000))) for i in range(6)]
    index = linededup.LineIndex.create(spark, least_docs=2).insert(frame(spark, texts[:1]))
    for step in (texts[1:4], texts[4:5], texts[5:]):
        index = index.insert(frame(spark, step))
        check_filters(index)
    index = index.delete(spark.createDataFrame([(2,)], "doc_id bigint"))
    check_filters(index)
    index = index.delete(spark.createDataFrame([(4,)], "doc_id bigint"))
    check_filters(index)


def check_filters(index):
    often = np.frombuffer(b"".join(bytes(r.key) for r in index.frequent().collect()), np.uint8).reshape(-1, 16)
    filters = index._read("filters").collect()
    assert sum(r.held for r in filters) == len(often)
    shard = linededup._shard_of(often, index.shards)
    for r in filters:
        f = linededup.Cuckoo(np.frombuffer(bytes(r.cells), np.uint16).reshape(-1, 4))
        assert f.has(often[shard == r.shard]).all()
        assert int((f.cells > 0).sum()) == (shard == r.shard).sum() == r.held


def test_cuckoo_filter_adds_and_removes():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (50_000, 16)).astype(np.uint8)
    f = linededup.Cuckoo.of_size(len(keys))
    assert f.add(keys) and f.has(keys).all()
    other = rng.integers(0, 256, (200_000, 16)).astype(np.uint8)
    assert f.has(other).mean() < 1e-3
    assert f.remove(keys[:30_000]) and f.has(keys[30_000:]).all() and f.has(keys[:30_000]).mean() < 1e-3
    assert int((f.cells > 0).sum()) == 20_000 and f.add(keys[:30_000]) and f.has(keys).all()
    assert not linededup.Cuckoo.of_size(1).add(keys[:1000])
    same = np.repeat(keys[:1], 8, axis=0)
    g = linededup.Cuckoo.of_size(8)
    assert g.add(same) and g.remove(same[:7]) and g.has(same[:1]).all() and g.remove(same[:1]) and not g.has(same[:1]).any()
    assert not g.remove(same[:1])


def test_least_chars_and_empty_tables(spark):
    rows = [(i, "é\nab\nabc") for i in range(3)]
    for chars in (0, 1, 2, 3):
        index = linededup.LineIndex.create(spark, least_docs=3, least_chars=chars).insert(frame(spark, rows))
        assert reported(index, spark, rows, inserted=True) == plain(rows, rows, 3, chars)
    none = linededup.LineIndex.create(spark).insert(frame(spark, []))
    assert not reported(none, spark, [], inserted=True)
    assert reported(none, spark, rows) == plain([], rows, 3)
    assert none.delete(spark.createDataFrame([(1,)], "doc_id bigint")).counts().isEmpty()
    later = none.insert(frame(spark, rows * 1))
    assert later.counts().count() == 3


@pytest.mark.parametrize("table", ["documents"])
def test_equals_sql(spark, sf, duck, table):
    got = queries.op11_line_dedup(spark, sf)
    want = Counter(duck.execute(oracles.LINES).fetchall())
    names = [c[0] for c in duck.description]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == want
    assert any(r[names.index("n_dropped")] for r in want)
    row = got.filter("n_dropped = 0").first()
    text = spark.read.parquet(f"{sf}/{table}.parquet").filter(F.col("doc_id") == row.doc_id).first().text
    assert row.kept_sha256 == hashlib.sha256((text or "").encode()).hexdigest()

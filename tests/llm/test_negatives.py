import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import negatives, oracles

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, twin int, width int"


def plain(rows, every=50, scale=256, k=5, m=3):
    """The contract, row by row: rows are (vec_id, embedding, label)."""
    able = set()
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        able.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, label, v in able:
        if i % every:
            continue
        others = sorted((-dot(v, w), j, y) for j, y, w in able if j != i)
        for s, j in [(-s, j) for s, j, y in others if y == label][:k]:
            good = [(-t, n) for t, n, y in others if y != label and 50 * s <= -100 * t <= 95 * s][:m]
            out += [(i, j, r + 1, n, s, t) for r, (t, n) in enumerate(good)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def mined(spark, rows, **kw):
    return sorted(tuple(r) for r in negatives.mine_table(frame(spark, rows), **kw).collect())


def test_mines_as_the_contract_says_on_ties_nulls_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 8], int(rng.integers(0, 3))) for i in range(160)]
    rows += [(i, [0.5] * 6, i % 4) for i in range(200, 280)]  # one vector for many rows
    rows += rows[:9] + [(0, [0.25] * 6, 1), (50, [0.5, 0.5], 2)]  # repeated rows, ids with a second vector, a shorter one
    odd = [(None, [1.0] * 6, 1), (300, None, 1), (350, [1.0] * 6, None), (400, [], 1), (450, [1.0, None] * 3, 1), (500, [float("nan")] * 6, 1), (550, [float("inf")] * 6, 1)]
    for every in (50, 10):
        want = plain(rows + odd, every)
        assert want and mined(spark, rows + odd, every=every) == want


def test_blocks_and_whole_numbers_agree(spark):
    """Components whose products double precision can't hold, and ties in the kernel."""
    rng = np.random.default_rng(6)
    large = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 4)], i % 2) for i in range(0, 120)]
    assert mined(spark, large, every=20) == plain(large, 20)
    score = rng.integers(-4, 5, (40, 30)).astype(np.int64)
    able = rng.random((40, 30)) < 0.4
    for s in (score, score.astype(float)):
        who, col, got = negatives.best(s, able, 4)
        want = [(r, c, s[r, c]) for r in range(40) for c in sorted(np.flatnonzero(able[r]), key=lambda c, r=r: (-s[r, c], c))[:4]]
        assert sorted(zip(who, col, got, strict=True)) == sorted(want)
    low = np.full((2, 3), np.iinfo(np.int64).min)
    assert len(negatives.best(low, np.ones((2, 3), bool), 2)[0]) == 4


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


@pytest.mark.parametrize("every", [50])
def test_equals_sql(spark, sf, duck, every):
    got = negatives.mine_table(spark.read.parquet(f"{sf}/embeddings.parquet"), every=every)
    names = [c[0] for c in duck.execute(oracles.NEGATIVES).description]
    want = sorted(tuple(int(x) for x in r) for r in duck.execute(oracles.NEGATIVES).fetchall())
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want and want
    blocked = got.sparkSession.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id"), F.lit(1).alias("label"), F.col("embedding").cast("array<bigint>").alias("v"), F.lit(0).cast("bigint").alias("twin"))
    packed = negatives.blocks(blocked, 64).collect()
    assert sum(len(r.ids) // 8 for r in packed) == blocked.count() and max(len(r.ids) // 8 for r in packed) <= 64

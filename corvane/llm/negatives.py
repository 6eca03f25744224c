"""Hard negatives for labelled vectors, by blocked dense matrix products.

Rows are packed to blocks of bounded size, in their id's order. Each block of anchors meets each block
of candidates; their scores are one matrix product in float64, which is exact while every sum stays below
2^53 (checked for each pair of blocks; whole numbers are multiplied otherwise). The first pass keeps each
anchor's best rows of its own label in each pair of blocks; these merge, in the task and after the shuffle,
to the anchor's positives. They set windows of scores, and a second pass over the same blocks keeps
the best rows of other labels within each window.

Rows with a null id or label, or whose vector is null, empty, or holds null or non-finite components, take no
part. Equal rows (id, label and vector) count once; rows of one id with other vectors or labels are rows of their
own, and as anchors have results of their own under that id. An anchor's own id is never its positive or negative.
Shorter vectors count as padded with zeros; scores and components beyond 64 bits stay at the limits of these. Ties go to
the smaller id. Fewer rows than asked for give all there are; an anchor without positives, and a window without rows,
give nothing. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from .common import arrow_task, map_arrow, written
from .topk import quantised, usable, whole_scores

#: Rows of a block of candidates and of a block of anchors: a score matrix of 16 MB.
CANDIDATES, ANCHORS = 4096, 512
CELLS_PER_CORE = 4
_BLOCK = "width int, size int, ids binary, twins binary, labels binary, data binary"
_HIT = "anchor_id bigint, twin bigint, slot int, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def _padded(lists: pa.Array, width: int) -> np.ndarray:
    off = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(off)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.values.to_numpy()[off[0] : off[-1]]
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in the smallest whole-number type that holds it."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def blocks(rows: DataFrame, size: int, windows: int = 0) -> DataFrame:
    """vec_id, twin, label, v packed to rows of at most `size` vectors in order of vec_id. With windows, also an array
    `positives` of (vec_id, score), at most so many, packed beside each vector."""
    more = ", positive_ids binary, positive_scores binary, n_positives binary" if windows else ""
    schema = T.StructType.fromDDL(_BLOCK + more)
    arrow = to_arrow_schema(schema)

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks().sort_by("vec_id")
        column = lambda name: table.column(name).combine_chunks()
        lists = column("v")
        data = _narrow(_padded(lists, max(1, int(np.diff(lists.offsets.to_numpy()).max(initial=0)))))
        out = [[data.shape[1]], [data.itemsize], *([np.ascontiguousarray(column(c).to_numpy(zero_copy_only=False).astype(np.int64)).tobytes()] for c in ("vec_id", "twin", "label")), [data.tobytes()]]
        if windows:
            found = column("positives")
            as_list = lambda f: _padded(pa.ListArray.from_arrays(found.offsets, found.values.field(f)), windows)
            out += [[as_list("vec_id").tobytes()], [as_list("score").tobytes()], [np.diff(found.offsets.to_numpy()).astype(np.int64).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, size - n)
                batch = batch.slice(take.num_rows)
                held.append(take)
                n += take.num_rows
                if n == size:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return rows.select("vec_id", "twin", "label", "v", *(["positives"] if windows else [])).mapInArrow(arrow_task(run), schema)


def _read(batch: pa.RecordBatch, i: int, mark: str) -> tuple:
    value = lambda c: batch.column(batch.schema.get_field_index(mark + c))[i].as_py()
    longs = [np.frombuffer(value(c), np.int64) for c in ("ids", "twins", "labels")]
    return *longs, np.frombuffer(value("data"), f"<i{value('size')}").reshape(len(longs[0]), value("width"))


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of c: float64 where that is exact, else whole numbers."""
    width = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, c))
    largest = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (a, c)]
    if width * largest[0] * largest[1] < 2**53:
        return a.astype(np.float64) @ c.T.astype(np.float64)
    return whole_scores(a.astype(np.int64), c.astype(np.int64))


def best(score: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best able columns of each row; of equal scores the first columns.

    One maximum after another: a vector that thousands of rows share makes no more work than any other."""
    floor = -np.inf if score.dtype.kind == "f" else np.iinfo(np.int64).min
    live, able = np.where(able, score, floor), able.copy()
    who, col = [], []
    for _ in range(min(k, score.shape[1])):
        at = np.where(able.any(axis=1), np.argmax(live, axis=1), -1) if score.dtype.kind == "f" else _first_best(live, able)
        rows = np.flatnonzero(at >= 0)
        if not len(rows):
            break
        who.append(rows)
        col.append(at[rows])
        live[rows, at[rows]], able[rows, at[rows]] = floor, False
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, col = np.concatenate(who), np.concatenate(col)
    return who, col, score[who, col].astype(np.int64)


def _first_best(live: np.ndarray, able: np.ndarray) -> np.ndarray:
    """First able column that holds the row's maximum (the least whole number is a score too), -1 where none is able."""
    top = live.max(axis=1, initial=np.iinfo(np.int64).min)
    return np.where(able.any(axis=1), np.argmax(able & (live == top[:, None]), axis=1), -1)


def _meet(anchors: DataFrame, candidates: DataFrame, hits) -> DataFrame:
    """All pairs of a block of anchors and a block of candidates; hits gives each pair's rows.

    Candidates' blocks are dealt over cells by number, so that a label, source or vector that many rows share makes no
    cell larger; each block of anchors goes to every cell once."""
    spark = candidates.sparkSession
    cells = max(8, CELLS_PER_CORE * spark.sparkContext.defaultParallelism)
    c = candidates.withColumn("cell", F.pmod(F.xxhash64("ids", "data"), F.lit(cells)).cast("int")).repartition(cells, "cell")
    a = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), *(F.col(x).alias(f"a_{x}") for x in anchors.columns)).repartition(cells, "cell")

    def run(batch):
        for i in range(batch.num_rows):
            a_ids, a_twins, a_labels, a_data = _read(batch, i, "a_")
            c_ids, _, c_labels, c_data = _read(batch, i, "")
            same = a_labels[:, None] == c_labels[None, :]
            yield from hits(batch, i, a_ids, a_twins, same, a_ids[:, None] != c_ids[None, :], c_ids, scores(a_data, c_data))

    return map_arrow(c.join(a, "cell").drop("cell"), run, _HIT)


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id bigint, label bigint,
    v array<bigint>): for each of an anchor's first `positives` rows of its label the first `negatives` rows of other labels
    whose score is between low and high per cent (at most 100) of the positive's."""
    rows = rows.select("vec_id", "label", "v", F.xxhash64("label", "v").alias("twin")).dropDuplicates(["vec_id", "label", "v"])
    rows = written(rows, "vectors")
    anchors = rows.filter(is_anchor)
    candidates = written(blocks(rows, CANDIDATES), "vector-blocks")

    def same_label(batch, i, a_ids, a_twins, same, other, c_ids, score):
        who, col, s = best(score, same & other, positives)
        none = np.zeros(len(who), np.int64)
        yield {"anchor_id": a_ids[who], "twin": a_twins[who], "slot": none, "positive_id": none, "positive_score": none, "vec_id": c_ids[col], "score": s}

    found = _first(_meet(written(blocks(anchors, ANCHORS), "anchor-blocks"), candidates, same_label), ["anchor_id", "twin"], positives)
    found = found.groupBy(F.col("anchor_id").alias("vec_id"), "twin").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))), lambda p: F.struct(p["vec_id"].alias("vec_id"), p["score"].alias("score"))).alias("positives"))  # at most `positives`
    windowed = written(blocks(anchors.join(found, ["vec_id", "twin"]), ANCHORS, positives), "anchor-blocks")

    def other_labels(batch, i, a_ids, a_twins, same, other, c_ids, score):
        read = lambda c: np.frombuffer(batch.column(batch.schema.get_field_index(f"a_{c}"))[i].as_py(), np.int64)
        p_ids, p_scores = (read(c).reshape(len(a_ids), positives) for c in ("positive_ids", "positive_scores"))
        n = read("n_positives")
        limits = [[(-(-low * s // 100), high * s // 100) for s in map(int, row)] for row in p_scores]  # whole numbers of any size
        able = ~same & other
        for slot in range(positives):
            lo, hi = (np.array([row[slot][j] for row in limits], score.dtype)[:, None] for j in (0, 1))
            who, col, s = best(score, able & (score >= lo) & (score <= hi) & (n > slot)[:, None], negatives)
            yield {"anchor_id": a_ids[who], "twin": a_twins[who], "slot": np.full(len(who), slot), "positive_id": p_ids[who, slot], "positive_score": p_scores[who, slot], "vec_id": c_ids[col], "score": s}

    out = _first(_meet(windowed, candidates, other_labels), ["anchor_id", "twin", "slot"], negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_table(embeddings: DataFrame, *, every: int = 50, scale: int = 256, shifted: int = 7, labels: int = 10) -> DataFrame:
    """Anchors: rows whose vec_id is divisible by `every`; where it is divisible by `shifted`, the label is first the next one."""
    vec_id, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    label = F.when(F.pmod(vec_id, F.lit(shifted)) == 0, (label + 1) % labels).otherwise(label)
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = embeddings.filter(ok).select(vec_id.alias("vec_id"), label.alias("label"), quantised(F.col("embedding"), scale).alias("v"))
    return mine(rows, F.pmod(F.col("vec_id"), F.lit(every)) == 0)

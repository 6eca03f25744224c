"""Exact top-k inner-product search by no-random-access aggregation.

Rows are packed into blocks of bounded size, each with its vectors sorted by every component. A
query reads those lists from the end that its component's sign favours, all at the same depth.
What has been read bounds each candidate from below (unread components at their list's worst) and
from above (at the depth's value); once at most a few candidates can still reach the k-th lower
bound, only their lists are read on for the final scores. Lists of a block of queries advance
together, so a step is two matrix products. Each pair of a query block and a candidate block
yields the block's best k; a window keeps the best k of each query.

A query's own id is no candidate of it (so repeated rows of one id aren't either). Vectors that
are null, empty, or hold null or non-finite components take no part; components and scores beyond 64 bits
stay at the limits of these; shorter vectors count as
padded with zeros. Equal query rows (id and vector) are one query; each different vector of one id is a
query of its own, with k results of its own under that id. Ties go to the smaller vec_id; equal rows of another id give one result each.
Fewer candidates than k give all of them; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from . import kernels as K
from .common import arrow_task, map_arrow, written

#: Rows of a candidate block and of a query block: about 2 MB of 64-component vectors, and a score matrix of 16 MB.
CANDIDATES, QUERIES = 4096, 512
#: Depths of the lists, as shares of the block, at which bounds are compared.
DEPTHS = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1.0)
CELLS_PER_CORE = 4


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def usable(embedding: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, ok)


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id, v (array of bigint) packed to rows of at most `size` vectors: block (unique), width, ids, data."""
    schema = T.StructType.fromDDL("block string, width int, ids binary, data binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held_ids, held, rows = [], [], 0

        def packed(ids, lists):
            nonlocal made
            width = max(int(np.diff(o).max(initial=0)) for o, _ in lists)
            out = np.zeros((sum(len(o) - 1 for o, _ in lists), width), np.int64)
            at = 0
            for off, flat in lists:
                n = len(off) - 1
                sizes = np.diff(off)
                out[at : at + n][np.arange(width) < sizes[:, None]] = flat
                at += n
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"]), pa.array([width], pa.int32()), pa.array([np.concatenate(ids).tobytes()]), pa.array([out.tobytes()])], schema=arrow)

        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                while part.num_rows:
                    take = part.slice(0, size - rows)
                    part = part.slice(take.num_rows)
                    lists = take.column(1)
                    off = lists.offsets.to_numpy().astype(np.int64)
                    held_ids.append(take.column(0).to_numpy())
                    held.append((off - off[0], lists.values.to_numpy()[off[0] : off[-1]]))
                    rows += take.num_rows
                    if rows == size:
                        yield packed(held_ids, held)
                        held_ids, held, rows = [], [], 0
        if rows:
            yield packed(held_ids, held)

    return vectors.mapInArrow(arrow_task(run), schema)


def _matrix(data: bytes, width: int, to: int) -> np.ndarray:
    x = np.frombuffer(data, np.int64).reshape(-1, width)
    return np.pad(x, ((0, 0), (0, to - width))) if to > width else x


def whole_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products where double precision can't hold them; beyond 64 bits they stay at the limits of these."""
    rough = q.astype(np.float64) @ c.T.astype(np.float64)
    with np.errstate(over="ignore"):
        scores = q @ c.T  # modulo 2^64, so right wherever the product fits
    edge = 2.0**63
    near = np.abs(np.abs(rough) - edge) <= q.shape[1] * 2.0**-50 * (np.abs(q).astype(np.float64) @ np.abs(c).T.astype(np.float64))
    scores[rough >= edge], scores[rough <= -edge] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    for i, j in zip(*np.nonzero(near), strict=True):
        exact = sum(a * b for a, b in zip(q[i].tolist(), c[j].tolist(), strict=True))
        scores[i, j] = min(max(exact, -(2**63)), 2**63 - 1)
    return scores


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best in the block, its own id left out."""
    n, width = c.shape
    exact_in_float = width * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2.0**52
    if not exact_in_float:
        who, col = np.nonzero(q_ids[:, None] != c_ids[None, :])
        return _cut(who, col, whole_scores(q, c)[who, col], c_ids, k)
    x = c.astype(np.float64).T
    lists = np.sort(x, axis=1)  # each component's list, ascending
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    both = np.concatenate([up, down], axis=1)
    todo = np.arange(len(q))
    out = []
    few = max(4 * k, 64)
    for depth in DEPTHS:
        t = min(n, max(k, int(np.ceil(depth * n))))
        top, bottom = lists[:, n - t][:, None], lists[:, t - 1][:, None]
        done = t == n
        if done:
            upper = lower = both[todo] @ np.concatenate([x, x])
        else:
            upper = both[todo] @ np.concatenate([np.maximum(x, top), np.minimum(x, bottom)])
            lower = both[todo] @ np.concatenate([np.where(x >= top, x, lists[:, :1]), np.where(x <= bottom, x, lists[:, -1:])])
        same = q_ids[todo][:, None] == c_ids[None, :]
        lower = np.where(same, -np.inf, lower)
        upper = np.where(same, -np.inf, upper)
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(todo), -np.inf)
        can = (upper >= kth[:, None]) & ~same
        left = can.sum(axis=1)
        ready = np.flatnonzero((left <= few) | done)
        if len(ready):
            row, col = np.nonzero(can[ready])
            who = todo[ready[row]]
            final = np.einsum("ij,ij->i", q[who], c[col])  # what is left of the contenders' lists
            out.append((who, col, final))
            todo = np.delete(todo, ready)
        if not len(todo):
            break
    who, col, score = (np.concatenate(p) for p in zip(*out, strict=True))
    return _cut(who, col, score, c_ids, k)


def _cut(who: np.ndarray, col: np.ndarray, score: np.ndarray, c_ids: np.ndarray, k: int):
    order = np.lexsort((c_ids[col], ~score, who))  # the complement orders as the negative, without overflow
    who, col, score = who[order], col[order], score[order]
    nth = np.arange(len(who)) - np.searchsorted(who, who)
    keep = nth < k
    return who[keep], col[keep], score[keep]


def _row_hash(m: np.ndarray) -> np.ndarray:
    """Tells the vectors of one id apart; zeros at the end don't change it."""
    weights = K.mix64(np.arange(1, m.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    return (K.mix64(m.astype(np.int64).view(np.uint64)) * weights).sum(axis=1, dtype=np.uint64).view(np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and v (array of bigint)."""
    spark = candidates.sparkSession
    cells = max(8, CELLS_PER_CORE * spark.sparkContext.defaultParallelism)
    # Equal query rows are one, whatever zeros they end with.
    size = F.array_max(F.transform("v", lambda x, i: F.when(x != 0, i + 1).otherwise(1)))
    queries = queries.select("vec_id", F.slice("v", 1, size).alias("v")).distinct()
    q = written(blocks(queries, QUERIES), "query-blocks").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    c = blocks(candidates, CANDIDATES).withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int"))
    q = q.select("cell", F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    pairs = c.select("cell", "width", "ids", "data").repartition(cells, "cell").join(q.repartition(cells, "cell"), "cell").drop("cell")

    def run(batch):
        for i in range(batch.num_rows):
            width, ids, data, q_width, q_ids, q_data = (batch.column(j)[i].as_py() for j in range(6))
            wide = max(width, q_width)
            q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
            q = _matrix(q_data, q_width, wide)
            who, col, score = search_block(q_ids, q, c_ids, _matrix(data, width, wide), k)
            yield {"query_id": q_ids[who], "query": _row_hash(q)[who], "vec_id": c_ids[col], "score": score}

    found = map_arrow(pairs, run, "query_id bigint, query bigint, vec_id bigint, score bigint")
    w = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_table(embeddings: DataFrame, *, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """Queries: rows whose vec_id is divisible by `every`; candidates: all rows but the query's own."""
    rows = embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"))
    queries = rows.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    return top_k(queries, rows, k)

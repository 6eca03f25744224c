"""Vector search: an IVF index table, searched by probing a few cells or exactly by bounds.

`build_ivf` fits centroids to a bounded sample of unit vectors (at most `sample` rows, a parameter; spherical k-means, seeded) and
assigns every vector to the cell of its nearest centroid. The index is a folder: `vectors` (cell, part, id, unit), sorted
by cell; `cells` (cell, n, parts, reach): `reach` is the smallest
cosine between a member and its centroid; `centroids`. Centroids are bounded by the parameter `cells` and go to all tasks.

An approximate search probes the `probes` nearest cells of each query. An exact one goes on: no member of a cell can
be nearer to a query than its angle to the centroid less the cell's widest angle, so cells whose bound stays below the k-th
score found so far are left out, and the others are read. Cells of many rows are dealt over parts.

Vectors and queries travel as blocks of bounded size. Each block of queries meets each block of vectors in one task; a query is
multiplied with its cells only, and what leaves the task is its k best of the block, if they reach its k-th score so far. So the
pairs that are scored, quadratic in an exact search that no bound can cut, are never rows of a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from ..sources.sinks import kept, shared_path

#: Rows of a part of a cell.
PART = 50_000
#: Rows of a block of vectors and of queries: 2 MB and 256 kB of 64 components.
VECTORS, QUERIES = 4096, 512
#: Places for each core that blocks meet in.
PLACES = 4
#: What rounding may add to a bound.
SLACK = 1e-9


def unit(v: Column) -> Column:
    """v by its length, as doubles; null for a null or zero vector and for one with null or non-finite components."""
    x = F.transform(v, lambda c: c.cast("double"))
    whole = F.size(v) > 0
    whole &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
    return F.when(whole & (norm > 0), F.transform(x, lambda c: c / norm))


def k_means(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors, by spherical k-means from seeded rows; empty cells take the rows that fit worst."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(x))
    c = x[np.sort(rng.choice(len(x), cells, replace=False))]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


@dataclass(frozen=True)
class IvfIndex:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def centroids(self) -> np.ndarray:
        """At most `cells` rows, the parameter of the build."""
        return np.array([r["unit"] for r in self.table("centroids").orderBy("cell").collect()], float)


def build_ivf(rows: DataFrame, key: str, embedding: str, path: str | None = None, *, cells: int | None = None, sample: int = 20_000, most_cells: int = 4096) -> IvfIndex:
    """The index of rows. cells: by default the square root of their number, most_cells at most. Rows with a null key or without
    a unit vector take no part; all other rows are indexed, repeated ones too. Vectors must have one length."""
    spark = rows.sparkSession
    path = path or shared_path(spark, "ivf")
    units = rows.select(F.col(key).alias("id"), unit(F.col(embedding)).alias("unit")).filter("id is not null and unit is not null")
    n = units.count()
    cells = min(cells or math.isqrt(n) or 1, most_cells)
    share = min(1.0, sample / max(n, 1))
    chosen = units.filter(F.pmod(F.xxhash64("id", "unit"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * sample)  # about `sample` of them
    x = np.array([r["unit"] for r in chosen.orderBy("id").collect()], float)
    centers = k_means(x, cells) if len(x) else np.zeros((0, 0))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, unit array<double>").write.mode("overwrite").parquet(f"{path}/centroids")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = np.stack(batch["unit"].to_numpy()) @ centers.T
                yield batch.assign(cell=near.argmax(axis=1).astype("int32"), near=near.max(axis=1))

    kind = units.schema["id"].dataType.simpleString()
    placed = units.mapInPandas(assign, f"id {kind}, unit array<double>, cell int, near double") if len(centers) else units.select("id", "unit", F.lit(0).alias("cell"), F.lit(0.0).alias("near"))
    placed.write.mode("overwrite").parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("reach")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).write.mode("overwrite").parquet(f"{path}/cells")
    sized = placed.join(F.broadcast(spark.read.parquet(f"{path}/cells").select("cell", "parts")), "cell")  # at most `cells` rows
    sized = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("cell", "part", "id", "unit")
    sized.repartition("cell", "part").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/vectors")
    return IvfIndex(spark, path)


def _blocks(df: DataFrame, size: int, schema: str, pack) -> DataFrame:
    """df in rows of blocks of at most `size` rows: pack makes the columns of one from a table of them."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block():
            made = pack(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) if not isinstance(made[f.name], pa.Array) else pa.ListArray.from_arrays([0, len(made[f.name])], made[f.name]).cast(f.type) for f in arrow], schema=arrow)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return df.mapInArrow(run, struct)


def _column(table: pa.Table, name: str) -> pa.Array:
    x = table.column(name)
    return x.chunk(0) if x.num_chunks == 1 else pa.concat_arrays(x.chunks)


def _matrix(units: pa.Array) -> np.ndarray:
    return units.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(units), -1)


def _rank_of_cells(score: np.ndarray) -> np.ndarray:
    """The place of each cell for each query, the nearest first."""
    order = np.argsort(-score, axis=1, kind="stable")
    nth = np.empty_like(order)
    np.put_along_axis(nth, order, np.arange(order.shape[1])[None, :], axis=1)
    return nth


def _units(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", unit(F.col("embedding")).alias("unit")).filter("query_id is not null and unit is not null")


def _scored(index: IvfIndex, queries: DataFrame, k: int, probes: int, kth: DataFrame | None = None) -> DataFrame:
    """query_id, id, score of the k best rows of each query (query_id, unit) in each block that holds some of its `probes` nearest cells;
    with kth (query_id, kth), in its other cells as far as their bound and the rows' score reach that."""
    centers = index.centroids()
    widest = {r["cell"]: math.acos(max(-1.0, min(1.0, r["reach"]))) for r in index.table("cells").collect()}  # at most `cells` rows
    wide = np.array([widest.get(i, 0.0) for i in range(len(centers))])
    vectors = index.table("vectors")
    kinds = [T.StructType([T.StructField(c, T.ArrayType(d.schema[c].dataType))]).simpleString()[7:-1] for d, c in ((queries, "query_id"), (vectors, "id"))]
    places = max(8, PLACES * index.spark.sparkContext.defaultParallelism)
    later = kth is not None
    asked = queries.join(kth, "query_id", "left") if later else queries.withColumn("kth", F.lit(None).cast("double"))

    def asking(table: pa.Table) -> dict:
        x = _matrix(_column(table, "unit"))
        score = np.clip(x @ centers.T, -1, 1)
        nth = _rank_of_cells(score)
        least = _column(table, "kth").fill_null(-np.inf).to_numpy(zero_copy_only=False)
        wanted = (nth >= probes) & (np.cos(np.maximum(0, np.arccos(score) - wide)) + SLACK >= least[:, None]) if later else nth < probes
        return {"query_id": _column(table, "query_id"), "asked": x.tobytes(), "least": least.tobytes(), "wanted": np.packbits(wanted, axis=1).tobytes()}

    def holding(table: pa.Table) -> dict:
        cell = _column(table, "cell").to_numpy().astype(np.int32)
        order = np.argsort(cell, kind="stable")
        return {"id": _column(table, "id").take(pa.array(order)), "cells": cell[order].tobytes(), "held": _matrix(_column(table, "unit"))[order].tobytes()}

    q = kept(_blocks(asked.select("query_id", "unit", "kth"), QUERIES, f"{kinds[0]}, asked binary, least binary, wanted binary", asking))
    q = q.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    v = _blocks(vectors.select("cell", "id", "unit"), VECTORS, f"{kinds[1]}, cells binary, held binary", holding)
    v = v.withColumn("place", F.pmod(F.xxhash64("cells", F.monotonically_increasing_id()), F.lit(places)).cast("int"))
    pairs = v.repartition(places, "place").join(q.repartition(places, "place"), "place").select("query_id", "asked", "least", "wanted", "id", "cells", "held")
    out = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                query_id, ids = batch.column(0)[i].values, batch.column(4)[i].values
                asked, least, wanted, cells, held = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((1, float), (2, float), (3, np.uint8), (5, np.int32), (6, float)))
                asked, held = asked.reshape(len(query_id), -1), held.reshape(len(ids), -1)
                wanted = np.unpackbits(wanted.reshape(len(query_id), -1), axis=1, count=len(centers)).astype(bool)
                who, col, score = _best_of_block(asked, least, wanted, cells, held, _order_of(ids), k)
                yield pa.RecordBatch.from_arrays([query_id.take(pa.array(who)), ids.take(pa.array(col)), pa.array(score)], schema=arrow)

    return pairs.mapInArrow(met, out)


def _order_of(ids: pa.Array) -> np.ndarray:
    """The place of each id among the block's."""
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return place


def _best_of_block(asked: np.ndarray, least: np.ndarray, wanted: np.ndarray, cells: np.ndarray, held: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows in its wanted cells that reach `least`; rows lie by cell.

    Products find the rows, up to rounding; their scores are then summed alike for all, so that equal vectors tie."""
    begin = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(cells))
    found = []
    for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
        who = np.flatnonzero(wanted[:, cells[lo]])
        if not len(who):
            continue
        s = asked[who] @ held[lo:hi].T
        floor = least[who]
        if hi - lo > k:
            floor = np.maximum(floor, np.partition(s, hi - lo - k, axis=1)[:, hi - lo - k])
        row, col = np.nonzero(s >= floor[:, None] - SLACK)
        found.append((who[row], lo + col))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who, col = (np.concatenate(x) for x in zip(*found, strict=True))
    score = np.concatenate([(asked[who[i : i + 65536]] * held[col[i : i + 65536]]).sum(axis=1) for i in range(0, max(len(who), 1), 65536)])
    order = np.lexsort((place[col], -score, who))
    who, col, score = who[order], col[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], col[keep], score[keep]


def _first(df: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def probe(index: IvfIndex, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """query_id, rank, id, score (cosine) of the k best rows in each query's nearest cells; ties by id. Queries are
    (query_id, embedding); one without a unit vector finds nothing. Rows of a query's own id are candidates too."""
    if not len(index.centroids()):
        return _empty(index, queries)
    return _first(_scored(index, _units(queries), k, probes), k)


def nearest_exact(index: IvfIndex, queries: DataFrame, k: int = 10, probes: int = 4) -> DataFrame:
    """As `probe`, but exact: cells that can hold one of the k best are all read."""
    if not len(index.centroids()):
        return _empty(index, queries)
    asked = _units(queries)
    found = kept(_first(_scored(index, asked, k, probes), k))
    kth = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    return _first(found.select("query_id", "id", "score").unionByName(_scored(index, asked, k, probes, kth)), k)


def probes_for(index: IvfIndex, asked: DataFrame, k: int = 10, least: float = 0.9) -> int:
    """How many cells a search probes to find the share `least` of the exact k best of the queries asked (a sample, stated by the caller):
    counted from the rank that the cell of each exact row has for its query."""
    exact = nearest_exact(index, asked, k).select("query_id", "id")
    home = index.table("vectors").select("id", "cell")
    centers = index.centroids()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch[lo : lo + 4096]
                nth = _rank_of_cells(np.clip(np.stack(part["unit"].to_numpy()) @ centers.T, -1, 1))
                yield pd.DataFrame({"nth": nth[np.arange(len(part)), part["cell"].to_numpy()]})

    nth = exact.join(home, "id").join(_units(asked), "query_id").select("cell", "unit").mapInPandas(place, "nth bigint")
    counts = sorted((r["nth"], r["n"]) for r in nth.groupBy("nth").agg(F.count("*").alias("n")).collect())  # a row a cell
    total, seen = sum(n for _, n in counts), 0
    for place, n in counts:
        seen += n
        if seen >= least * total:
            return place + 1
    return 1


def _empty(index: IvfIndex, queries: DataFrame) -> DataFrame:
    return queries.join(index.table("vectors").select("id"), F.lit(False)).select("query_id", F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, found, recall: the share of the exact rows that were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("_hit")).distinct()
    x = exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("_hit").alias("found"))
    return x.withColumn("recall", F.col("found") / F.col("wanted"))

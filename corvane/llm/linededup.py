"""Reversible incremental line dedup: sharded cuckoo filters backed by exact reference-count tables.

A `LineIndex` is a folder of tables. `events` logs documents that came and went, with the digests of their distinct line
keys; `counts` has for each key the exact number of documents that hold it; `filters` has one cuckoo filter a
shard, of the keys that reach `least_docs` documents. Inserting or deleting documents adds their signed counts,
and keys that cross the limit enter or leave their shard's filter. Nothing is lost from documents, so a line that
falls below the limit again is back in all texts that are cleaned from then on.

Cleaning sends digests to their shard in packed rows; almost all lines end at the filter there, and what passes is verified in
the table of counts. Documents meet only their own verified keys again. Each update writes new versions of the tables and
names them in `meta` last, so an update that broke off leaves no trace.

A line's key is the line without ASCII white space at both ends, A-Z in lower case; keys of fewer than `least_chars` code points
are never dropped. Keys are known by 128-bit digests. A document is an id with its text: equal rows count once, inserting a document that is
in the index changes nothing, and so does deleting an unknown id (a null id deletes documents with a null id). Null and empty texts are one empty
line. Repeated lines of a document count once and are dropped everywhere. Empty tables give empty results; other columns are
ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import kernels as K
from .common import arrow_task, map_arrow, work_path

#: Keys that a shard's filter is meant to hold, the fewest shards, and the keys that one task holds while it packs them by shard.
SHARD_KEYS, LEAST_SHARDS, HELD_KEYS = 1 << 18, 32, 1 << 18
SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four a bucket; equal fingerprints are kept as often as they were added."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells, np.uint64(len(cells) - 1)

    @classmethod
    def of_size(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(4, math.ceil(math.log2(max(1, keys) / (0.8 * SLOTS)))), SLOTS), np.uint16))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and first buckets of n x 16 bytes."""
        x = np.ascontiguousarray(keys[:, 8:]).view("<u8").ravel()
        return np.maximum(x & np.uint64(0xFFFF), 1).astype(np.uint16), ((x >> np.uint64(16)) & self.mask).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (K.mix64(mark.astype(np.uint64)) & self.mask).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, at = self._places(keys)
        return ((self.cells[at] == mark[:, None]) | (self.cells[self._other(mark, at)] == mark[:, None])).any(axis=1)

    def add(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """False if there isn't room; the filter is of no use then."""
        mark, at = self._places(keys)
        moved = np.zeros(len(mark), bool)  # its first bucket was full
        rng = np.random.default_rng(len(mark))
        for _ in range(rounds):
            if not len(mark):
                return True
            free = self.cells[at] == 0
            roomy = free.any(axis=1)
            at[~roomy & ~moved] = self._other(mark, at)[~roomy & ~moved]
            evict = ~roomy & moved
            moved |= ~roomy
            slot = np.where(roomy, free.argmax(axis=1), rng.integers(0, SLOTS, len(mark)))
            act = np.flatnonzero(roomy | evict)
            act = act[np.unique(at[act] * SLOTS + slot[act], return_index=True)[1]]  # one a slot and round
            out = self.cells[at[act], slot[act]]
            self.cells[at[act], slot[act]] = mark[act]
            mark[act], at[act] = out, self._other(out, at[act])
            live = np.ones(len(mark), bool)
            live[act] = out != 0
            mark, at, moved = mark[live], at[live], moved[live]
        return not len(mark)

    def remove(self, keys: np.ndarray) -> bool:
        """False if one of the keys isn't there."""
        mark, at = self._places(keys)
        while len(mark):
            both = np.stack([at, self._other(mark, at)], axis=1)
            hit = (self.cells[both] == mark[:, None, None]).reshape(len(mark), -1)
            if not hit.any(axis=1).all():
                return False
            nth = hit.argmax(axis=1)
            place = both[np.arange(len(mark)), nth // SLOTS] * SLOTS + nth % SLOTS
            act = np.unique(place, return_index=True)[1]
            self.cells.reshape(-1)[place[act]] = 0
            live = np.ones(len(mark), bool)
            live[act] = False
            mark, at = mark[live], at[live]
        return True


def _digests(column) -> np.ndarray:
    """n x 16 bytes of a binary column of digests."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.ascontiguousarray(keys[:, :4]).view(">u4").ravel().astype(np.int64) % shards


def _shard(key: Column, shards: int) -> Column:
    return (F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint") % shards).cast("int")


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """The digest of a line's key; None if it is too short."""
    key = line.strip(SPACE).lower()
    if len(key) < least_chars or least_chars > 1 and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return blake2b(key, digest_size=16).digest() if key or least_chars < 1 else None


def _named(docs: DataFrame) -> DataFrame:
    """The document's name: 128 bits of its id and text."""
    return docs.withColumns({"_a": F.xxhash64("doc_id", "text"), "_b": F.xxhash64(F.coalesce("text", F.lit("")), "doc_id", F.lit(11))})


def document_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """_a, _b, doc_id, keys: the digests of each document's distinct line keys, one after another."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("_a", T.LongType()), T.StructField("_b", T.LongType()), T.StructField("doc_id", kind), T.StructField("keys", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                keys = []
                for text in part.column(3).cast(pa.binary()).to_pylist():
                    found = {line_key(line, least_chars) for line in (text or b"").split(b"\n")}
                    found.discard(None)
                    keys.append(b"".join(found))
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(arrow.field(i).type) for i in range(3)), pa.array(keys, pa.binary())], schema=arrow)

    x = _named(docs.select("doc_id", "text")).select("_a", "_b", "doc_id", "text")
    return x.mapInArrow(arrow_task(run), schema)


def key_counts(documents: DataFrame) -> DataFrame:
    """key, n: signed numbers of documents, added up in the task first, then by Spark."""

    def run(batch):
        sign = batch.column(1).to_numpy()
        keys = batch.column(0).to_pylist()
        flat = np.frombuffer(b"".join(keys), "V16")
        signs = np.repeat(sign, [len(k) // 16 for k in keys])
        for one in (1, -1):
            found, n = np.unique(flat[signs == one], return_counts=True)
            yield {"key": found.tolist(), "n": one * n}

    return map_arrow(documents.select("keys", F.col("sign").cast("int")), run, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


_FILTER = "shard int, held bigint, cells binary, fits boolean"


def _built(keys: DataFrame) -> DataFrame:
    """Filters of (shard, key), sized for their keys; a shard holds about SHARD_KEYS."""

    def run(table: pa.Table) -> pa.Table:
        k = _digests(table.column("key"))
        size = len(k)
        while not (f := Cuckoo.of_size(size)).add(k):
            size *= 2
        return _filter_row(table.column("shard")[0].as_py(), len(k), f, True)

    return keys.select("shard", "key").groupBy("shard").applyInArrow(run, _FILTER)


def _filter_row(shard: int, held: int, f: Cuckoo, fits: bool) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "held": pa.array([held], pa.int64()), "cells": pa.array([f.cells.tobytes()], pa.binary()), "fits": [fits]})


def _changed(filters: DataFrame, changes: DataFrame) -> DataFrame:
    """Filters with the keys of (shard, key, up) put in or taken out; fits is false where a filter has to be built anew."""

    def run(key, rows: pa.Table, old: pa.Table) -> pa.Table:
        cells = old.column("cells")[0].as_py() if len(old) else None
        f = Cuckoo(np.frombuffer(cells, np.uint16).reshape(-1, SLOTS).copy()) if cells else Cuckoo.of_size(1)
        held = old.column("held")[0].as_py() if len(old) else 0
        fits = True
        if len(rows):
            k, up = _digests(rows.column("key")), rows.column("up").to_numpy()
            held += int(up.sum()) - int((~up).sum())
            fits = f.remove(k[~up]) and held <= 0.95 * f.cells.size and f.add(k[up])
        return _filter_row(key[0].as_py(), held, f, fits)

    return changes.select("shard", "key", "up").groupBy("shard").cogroup(filters.select("shard", "held", "cells").groupBy("shard")).applyInArrow(run, _FILTER)


@dataclass(frozen=True)
class LineIndex:
    """The index in a folder; each change gives the index of its next version and leaves this one as it is."""

    spark: SparkSession
    path: str
    least_docs: int = 10
    least_chars: int = 1
    version: int = 0
    shards: int = 0

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, *, least_docs: int = 10, least_chars: int = 1) -> LineIndex:
        return cls(spark, path or work_path(spark, "line-index"), least_docs, least_chars)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The last complete version in the folder."""
        last = spark.read.schema("version int, shards int, least_docs int, least_chars int").json(f"{path}/meta").orderBy(F.desc("version")).first()
        return cls(spark, path, last["least_docs"], last["least_chars"], last["version"], last["shards"])

    def _read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}/v={self.version if version is None else version}")

    def events(self) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/events/v={v}" for v in range(1, self.version + 1)))

    def documents(self) -> DataFrame:
        """_a, _b, doc_id and keys of the documents that the index holds."""
        if self.version == 1:
            return self.events().drop("sign")
        live = self.events().groupBy("_a", "_b").agg(F.sum("sign").alias("n")).filter("n > 0").select("_a", "_b")
        came = self.events().filter("sign > 0").join(live, ["_a", "_b"], "left_semi")
        return came.drop("sign").dropDuplicates(["_a", "_b"])

    def counts(self) -> DataFrame:
        """key and the number n of documents that hold it."""
        return self._read("counts").filter("n > 0").select("key", "n")

    def frequent(self) -> DataFrame:
        return self._read("counts").filter(F.col("n") >= self.least_docs).select("key")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs (doc_id, text) in it."""
        came = document_keys(docs, self.least_chars).dropDuplicates(["_a", "_b"])
        if self.version:
            came = came.join(self.documents().select("_a", "_b"), ["_a", "_b"], "left_anti")
        return self._next(came.withColumn("sign", F.lit(1)))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents that have one of the ids (doc_id)."""
        if not self.version:
            return self
        gone = ids.select(F.col("doc_id").alias("_id")).distinct()
        out = self.documents().join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        return self._next(out.select("_a", "_b", "doc_id", "keys").withColumn("sign", F.lit(-1)))

    def _next(self, events: DataFrame) -> LineIndex:
        to, spark = self.version + 1, self.spark
        events.write.mode("overwrite").parquet(f"{self.path}/events/v={to}")
        counts = key_counts(self._read("events", to)).withColumn("was", F.lit(0).cast("bigint"))
        if self.version:
            known = self.counts().select("key", "n", F.col("n").alias("was"))
            counts = known.unionByName(counts).groupBy("key").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/v={to}")
        counts = self._read("counts", to)
        often = counts.filter(F.col("n") >= self.least_docs)
        need = often.count() / SHARD_KEYS
        shards = self.shards if self.shards and need <= 2 * self.shards else max(LEAST_SHARDS, 1 << math.ceil(math.log2(max(1.0, need))))
        often = often.withColumn("shard", _shard(F.col("key"), shards))
        if shards != self.shards:
            filters = _built(often)
        else:
            crossed = counts.filter((F.col("n") >= self.least_docs) != (F.col("was") >= self.least_docs))
            changes = crossed.select(_shard(F.col("key"), shards).alias("shard"), "key", (F.col("n") >= self.least_docs).alias("up"))
            step = f"{self.path}/changed/v={to}"
            _changed(self._read("filters"), changes).write.mode("overwrite").parquet(step)
            tried = spark.read.parquet(step)
            filters = tried.filter("fits").unionByName(_built(often.join(tried.filter(~F.col("fits")).select("shard"), "shard")))
        filters.write.mode("overwrite").parquet(f"{self.path}/filters/v={to}")
        spark.range(1).select(F.lit(to).alias("version"), F.lit(shards).alias("shards"), F.lit(self.least_docs).alias("least_docs"), F.lit(self.least_chars).alias("least_chars")).coalesce(1).write.mode("append").json(f"{self.path}/meta")
        return LineIndex(spark, self.path, self.least_docs, self.least_chars, to, shards)

    def dropped_keys(self, documents: DataFrame) -> DataFrame:
        """_a, _b, gone: the keys of (_a, _b, keys) that the index drops, by document."""
        shards = self.shards

        def pack(batches):
            """Packed rows by shard: names and digests side by side."""
            held, n = [], 0

            def packed():
                names, keys = (np.concatenate(x) for x in zip(*held, strict=True))
                shard = _shard_of(keys, shards)
                order = np.argsort(shard, kind="stable")
                found, at = np.unique(shard[order], return_index=True)
                cuts = [*at, len(order)]
                rows = [order[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([names[r].tobytes() for r in rows], pa.binary()), pa.array([keys[r].tobytes() for r in rows], pa.binary())], ["shard", "names", "keys"])

            for batch in batches:
                a, b = (batch.column(i).to_numpy() for i in (0, 1))
                keys = batch.column(2).to_pylist()
                sizes = [len(k) // 16 for k in keys]
                if sum(sizes):
                    held.append((np.repeat(np.stack([a, b], axis=1), sizes, axis=0), np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)))
                    n += sum(sizes)
                if n >= HELD_KEYS:
                    yield packed()
                    held, n = [], 0
            if held:
                yield packed()

        def probe(batch):
            for i in range(batch.num_rows):
                names, keys, cells = (batch.column(j)[i].as_py() for j in range(3))
                keys = np.frombuffer(keys, np.uint8).reshape(-1, 16)
                hit = Cuckoo(np.frombuffer(cells, np.uint16).reshape(-1, SLOTS)).has(keys)
                name = np.frombuffer(names, np.int64).reshape(-1, 2)[hit]
                yield {"_a": name[:, 0], "_b": name[:, 1], "key": [k.tobytes() for k in keys[hit]]}

        packed = documents.select("_a", "_b", "keys").mapInArrow(arrow_task(pack), "shard int, names binary, keys binary")
        met = packed.join(self._read("filters").select("shard", "cells"), "shard").select("names", "keys", "cells")
        likely = map_arrow(met, probe, "_a bigint, _b bigint, key binary")
        return likely.join(self.frequent(), "key", "left_semi").groupBy("_a", "_b").agg(F.collect_set("key").alias("gone"))

    def _with_gone(self, docs: DataFrame, inserted: bool) -> DataFrame:
        known = self.documents() if inserted else document_keys(docs, self.least_chars).dropDuplicates(["_a", "_b"])
        return _named(docs).join(self.dropped_keys(known), ["_a", "_b"], "left").drop("_a", "_b")

    def report(self, docs: DataFrame, inserted: bool = False) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept (text) of docs. inserted: all of docs are in the index, so that the keys it
        has of them are used."""
        kind, least_chars = docs.schema["doc_id"].dataType, self.least_chars
        schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.BinaryType())])
        arrow = to_arrow_schema(schema)

        def run(batches):
            for batch in batches:
                for part in K.slices(batch):
                    total, lost, kept = [], [], []
                    for text, gone in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                        lines = (text or b"").split(b"\n")
                        gone = set(gone or ())
                        stay = [x for x in lines if line_key(x, least_chars) not in gone] if gone else lines
                        total.append(len(lines))
                        lost.append(len(lines) - len(stay))
                        kept.append(b"\n".join(stay))
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, arrow.field(3).type)], schema=arrow)

        x = self._with_gone(docs.select("doc_id", "text"), inserted).select("doc_id", "text", "gone")
        return x.mapInArrow(arrow_task(run), schema).withColumn("kept", F.col("kept").cast("string"))


def dedup_table(docs: DataFrame, *, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept of a whole table, indexed from nothing."""
    return LineIndex.create(docs.sparkSession, least_docs=least_docs, least_chars=least_chars).insert(docs).report(docs, inserted=True)

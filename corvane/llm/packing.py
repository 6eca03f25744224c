"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Documents become pieces of 1 to `room` tokens. An instance is fully given by how many pieces
there are of each length, at most `room` numbers, so the driver solves it on that histogram
whatever the size of the corpus: the reduction fixes sets that dominate every alternative for the
largest piece (it alone, with a partner that fills the sequence, with the largest partner when no
second one fits, or when no two partners fill more), then best-fit decreasing packs the rest.
Equal sequences are kept as one pattern with a count. Pieces then find their place by their rank
among the pieces of their length; ranks come from counts per (task, length), never from one sort.

Null texts are empty documents: one piece that holds the end token. Repeated rows are packed once
each; rows with a null doc_id too. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from . import kernels as K
from .bpe import Encoder
from .common import arrow_task, kept_by, written

_encoders: dict[str, Encoder] = {}
kept_by("packing", _encoders.clear)


def encoder(path: str) -> Encoder:
    """The worker's encoder over a tokenizer.json; the tokenizers library encodes each piece when it is first met."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True  # their strings in a text are ordinary text

        def merge(data, starts, lengths):
            raw = data.tobytes()
            texts = [raw[a : a + n].decode() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            ids = [e.ids for lo in range(0, len(texts), 4096) for e in tok.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False)]
            return np.fromiter((x for y in ids for x in y), np.uint32), np.array([len(x) for x in ids], np.int64)

        _encoders[path] = Encoder(merge)
    return _encoders[path]


#: Text that is encoded at once, and about how much a task sends to Python at once: with the tokenizer a worker is large enough.
SLICE_BYTES, BATCH = 1 << 19, "4m"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


def cut_documents(docs: DataFrame, vocabulary: str, room: int, end_id: int) -> DataFrame:
    """A row per piece, with the task that made it and its number among that task's pieces of its length."""
    arrow = to_arrow_schema(T.StructType.fromDDL(PIECES))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, seen = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        enc = encoder(vocabulary)
        for batch in batches:
            for part in K.slices(batch, most=SLICE_BYTES):
                data, off, _ = K.utf8(part.column(1))
                ids, at = enc.encode(data, off)
                n = part.num_rows
                total = np.diff(at) + 1
                first = np.where(total % room, total % room, room)
                count = 1 + (total - first) // room
                doc = np.repeat(np.arange(n), count)
                piece = K.ranges(np.zeros(n, np.int64), count)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * room)
                length = np.where(piece == 0, first[doc], room)
                # ids with the end token after each document
                full = np.insert(ids.astype("<u4"), at[1:], end_id).tobytes()
                lo = (at[:-1] + np.arange(n))[doc] + start
                crc = [zlib.crc32(full[4 * a : 4 * (a + k)]) for a, k in zip(lo.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                runs = length[order]
                within = np.arange(len(runs)) - np.searchsorted(runs, runs)
                nth = np.empty(len(runs), np.int64)
                nth[order] = within
                nth += seen[length]
                seen += np.bincount(length, minlength=room + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)],
                    schema=arrow,
                )

    return docs.select("doc_id", "text").mapInArrow(arrow_task(run, "packing"), PIECES)


def reduce_instance(count: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction on a histogram (index: length), which it lowers in place: (set, how often) that are fixed."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(items: tuple[int, ...], times: int) -> None:
        for x in items:
            count[x] -= times
        fixed.append((items, times))

    for w in range(room, 0, -1):
        while count[w] > 0:
            gap = room - w
            below = np.flatnonzero(count[: gap + 1] > 0)
            if w in below:
                if count[w] == 1:
                    below = below[below != w]
            if not len(below):  # nothing fits beside it
                take((w,), int(count[w]))
                continue
            partner = int(below[-1])
            smallest = int(below[0])
            second = smallest if count[smallest] - (smallest == w) > 1 else (int(below[1]) if len(below) > 1 else gap + 1)
            best_pair = _best_pair(count, below, gap, w) if partner < gap and smallest + second <= gap else 0
            if partner == gap or smallest + second > gap or best_pair <= partner and _triple_free(count, below, gap, w):
                times = int(count[w]) // 2 if partner == w else int(min(count[w], count[partner]))
                take((w, partner), max(times, 1))
                continue
            break  # no set of at most two dominates: best-fit takes this length
    return fixed


def _best_pair(count: np.ndarray, below: np.ndarray, gap: int, w: int) -> int:
    """The largest sum of two pieces that fit into the gap."""
    best, lo, hi = 0, 0, len(below) - 1
    have = lambda x: count[x] - (x == w)
    while lo <= hi:
        a, b = int(below[lo]), int(below[hi])
        if a + b > gap:
            hi -= 1
        else:
            if a != b or have(a) > 1:
                best = max(best, a + b)
            lo += 1
    return best


def _triple_free(count: np.ndarray, below: np.ndarray, gap: int, w: int) -> bool:
    """Whether no three further pieces fit into the gap."""
    least = 0
    left = 3
    for x in below.tolist():
        n = min(left, int(count[x]) - (x == w))
        least, left = least + n * x, left - n
        if not left:
            return least > gap
    return True


def best_fit(count: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: patterns and how often."""
    groups: dict[int, list[list]] = {}  # by room left: [pattern, how often]
    for w in range(room, 0, -1):
        n = int(count[w])
        while n > 0:
            r = next((r for r in range(w, room) if groups.get(r)), 0)
            if not r:
                per = room // w
                full, rest = divmod(n, per)
                if full:
                    groups.setdefault(room - per * w, []).append([(w,) * per, full])
                if rest:
                    groups.setdefault(room - rest * w, []).append([(w,) * rest, 1])
                n = 0
                continue
            group = groups[r][-1]
            each = min(r // w, n)
            times = min(group[1], n // each)
            group[1] -= times
            if not group[1]:
                groups[r].pop()
            groups.setdefault(r - each * w, []).append([group[0] + (w,) * each, times])
            n -= each * times
    return [(tuple(p), k) for g in groups.values() for p, k in g]


def solve(count: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that use up the histogram, and how often each is used."""
    count = count.copy()
    fixed = reduce_instance(count, room)
    return fixed + best_fit(count, room)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence_id, offset); the rank within a row counts sequences on."""
    rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for items, times in patterns:
        at = 0
        for w in items:
            r = rank.get(w, 0)
            out.setdefault(w, []).append((r, first, at))
            rank[w] = r + times
            at += w
        first += times
    return {w: np.array(rows, np.int64) for w, rows in out.items()}


def pack_documents(docs: DataFrame, vocabulary: str, *, room: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(cut_documents(docs, vocabulary, room, end_id), "pieces", BATCH)
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    count = np.zeros(room + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `room` rows
        count[row.length] = row.n
    where = places(solve(count, room))
    base = per_task.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).select("length", "task", "base")
    ranked = pieces.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    schema = T.StructType.fromDDL("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    rows = where[int(length[part[0]])]
                    k = np.searchsorted(rows[:, 0], rank[part], "right") - 1
                    sequence[part] = rows[k, 1] + rank[part] - rows[k, 0]
                    offset[part] = rows[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.mapInArrow(arrow_task(run, "packing"), schema)

"""N-gram Jaccard join by universe partition and pigeonhole, and its connected components.

A document's set is its distinct word shingles. Sets of a size band hash the universe of shingles
into m segments. Two sets whose Jaccard similarity reaches the threshold differ in at most H
shingles, so of any H + 1 segments one holds the same subset of both: a signature (band, segment,
subset) that they share. Segments may also be indexed with their one-deletion neighbourhood, which
tolerates one difference and counts twice. `allocate` picks m and the number of such segments for
each band by the expected number of signatures, such that practically every set has the H + 1
non-empty segments it needs (sets that haven't are compared with all documents, in one pass over
them). Of its segments a set uses the H + 1 cheapest: those whose signature nobody shares cost
nothing, and most documents end there.

Equal sets are one node, whatever the number of copies. Round one verifies each bucket's members
against a few of them; most buckets then lie within one component. Round two verifies the pairs
of the cheapest remaining buckets whose members are in different components. So no pair that could
join two components is left out, and a group of near copies never becomes all its pairs.

A passage that very many documents share makes large buckets, but few of their members count: each
segment of a set that no other set of another component shares is a difference, so a set with more
of them than a link allows (`most`) takes no part. This is counted again for what remains. Two sets
that meet in several buckets are a candidate pair in the first of them only, as far as the LOOK_BACK
buckets that each has before this one tell.

Signatures travel as packed binary blocks per slot; the number of slots follows the corpus. Texts
are fetched for candidates only, through a bit filter of fixed size. Shingles are identified by
64-bit hashes within a pair of sets, sets by 128-bit digests of these.

Null and empty texts, and texts without a word, have an empty set, link with nothing and are their
own component. Texts with fewer words than a shingle are one shingle. Rows with a null doc_id take
no part and have a null component. Rows that repeat a doc_id take part each with its own text; their
component is that of any of them that links. Extra columns are ignored or passed through.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from . import kernels as K
from .common import arrow_task, dropped, end_task, map_arrow, written

#: Sets up to this size have a segment for each shingle.
SMALL = 64
SINGLE = 1 << 31
SIGNATURES_PER_SLOT = 2_000_000
LEAST_SLOTS, MOST_PARTITIONS = 32, 50_000
MARGIN = 6.5  # standard deviations between the segments that a set needs and those it has
FILTER_BITS = 24


def most_differences(size: int, percent: int) -> int:
    """The most shingles in which a set of this size differs from a larger one that links with it."""
    return int(size * (100 - percent) // percent)


@lru_cache(256)
def allocate(high: int, percent: int) -> tuple[int, int]:
    """(segments, how many of them with deletions) for sets of up to `high` shingles, by expected signatures."""
    if high <= SMALL:
        return SINGLE, 0
    need = most_differences(high, percent) + 1
    best = (float(high), SINGLE, 0)
    for m in sorted({int(need * (1 + k / 40)) for k in range(0, 120)}):
        lam = high / m
        e0, e1 = math.exp(-lam), lam * math.exp(-lam)
        for share in (0.0, 0.1, 0.25, 0.5, 1.0):
            t = int(share * m)
            capacity = m * (1 - e0) + t * (1 - e0 - e1)
            spread = math.sqrt(max(1e-9, m * e0 * (1 - (1 + lam) * e0))) * (1 + t / m)
            cost = m * (1 - e0) + t * (lam - e1)
            if capacity >= need + MARGIN * spread and cost < best[0]:
                best = (cost, m, t)
    return best[1], best[2]


def band(size: np.ndarray) -> np.ndarray:
    """Sizes 1..64 are band 0, then each band doubles."""
    return np.maximum(np.ceil(np.log2(np.maximum(size, 1) / SMALL)), 0).astype(np.int64)


def band_high(b: int) -> int:
    return SMALL << int(b)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending within each document, and documents' offsets."""
    n = len(off) - 1
    starts, ends, count = K.words(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = K.span_hash(K.lower_ascii(data), starts, ends)
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(n), count)
    last = (first + np.maximum(count - width, 0))[doc]  # the last shingle begins here
    at = np.flatnonzero(np.arange(len(h)) <= last)
    own = doc[at]
    end = (first + count)[own]
    key = np.minimum(count[own], width).astype(np.uint64)
    for k in range(width):
        nxt = at + k
        live = nxt < end
        key = np.where(live, K.mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(nxt, len(h) - 1)]), key)
    order = np.argsort(key)
    key, own = key[order], own[order]
    order = np.argsort(own.astype(np.uint16) if n < 65536 else own, kind="stable")
    key, own = key[order], own[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[fresh], own[fresh]
    return key, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])


def set_digest(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each document's set, as two numbers a row; 0 and 0 for the empty set."""
    size = np.diff(off)
    out = np.zeros((len(size), 2), np.uint64)
    for k, seed in enumerate((0xA5A5A5A55A5A5A5A, 0x3C6EF372FE94F82B)):
        total = np.zeros(len(key) + 1, np.uint64)
        np.cumsum(K.mix64(key ^ np.uint64(seed)), out=total[1:])
        out[:, k] = K.mix64((total[off[1:]] - total[off[:-1]]) ^ K.mix64(size.astype(np.uint64) + np.uint64(k)))
    out[size == 0] = 0
    return out


def node_names(digest: np.ndarray) -> pa.Array:
    """Digests as 16 bytes each."""
    raw = np.ascontiguousarray(digest, np.uint64)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())


#: 64-bit words of a set's parity sketch. Each shingle flips one bit, so two sets' sketches differ in no more bits than the sets in shingles.
WORDS = 8
SKETCH = [f"s{k}" for k in range(WORDS)]


def parity_sketch(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    bit = (K.mix64(key ^ np.uint64(0x3C3C3C3CC3C3C3C3)) % np.uint64(64 * WORDS)).astype(np.int64)
    odd = np.bincount(doc * (64 * WORDS) + bit, minlength=n * 64 * WORDS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, 64 * WORDS), axis=1).view(np.int64).reshape(n, WORDS)


def _may_link(percent: int):
    """Whether the sketches of a and b leave room for a link; exact in that it never says no to one."""
    apart = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"a_{SKETCH[0]}").bitwiseXOR(F.col(f"b_{SKETCH[0]}"))))
    return apart <= F.floor((F.col("size_a") + F.col("size_b")) * (100 - percent) / (100 + percent))


def _segments(key: np.ndarray, off: np.ndarray, docs: np.ndarray, m: np.ndarray, b: np.ndarray, deleting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in docs, signature) of the sets' non-empty segments and deletions; and segments per set."""
    size = np.diff(off)[docs]
    rows = K.ranges(off[:-1][docs], size)
    pos = np.repeat(np.arange(len(docs)), size)
    x = key[rows]
    seg = ((x >> np.uint64(33)) * m[pos].astype(np.uint64)) >> np.uint64(31)
    new = np.ones(len(x), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (pos[1:] != pos[:-1])
    starts = np.flatnonzero(new)
    each = K.mix64(x)
    total = np.add.reduceat(each, starts) if len(starts) else np.zeros(0, np.uint64)
    owner, s = pos[starts], seg[starts]
    salt = K.mix64((s << np.uint64(8)) ^ b[owner].astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    sig = K.mix64(total ^ salt)
    per_set = np.bincount(owner, minlength=len(docs))
    if deleting.any():
        k = np.diff(np.append(starts, len(x)))
        deep = (s < deleting[owner].astype(np.uint64)) & (k > 1)
        if deep.any():
            part = K.ranges(starts[deep], k[deep])
            which = np.repeat(np.flatnonzero(deep), k[deep])
            sig = np.concatenate([sig, K.mix64((total[which] - each[part]) ^ salt[which])])
            owner = np.concatenate([owner, owner[which]])
    return owner, sig, per_set


#: segments: of the set's own band; less than 0: -1 - those of the band below, where the set is a probe. 0 and -1: not known.
ENTRY = np.dtype([("node", "<u8", 2), ("size", "<i4"), ("segments", "<i4")])


def signature_blocks(docs: DataFrame, slots: int, width: int, percent: int) -> DataFrame:
    """slot, entries, counts, signatures: packed per 8 MB of text; equal sets of a task appear once."""
    schema = T.StructType.fromDDL("slot int, entries binary, counts binary, signatures binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen: set[bytes] = set()
        for batch in (part for whole in batches for part in K.slices(whole, most=4 * K.SLICE_BYTES)):
            nodes, sizes, segments, owners, sigs, base = [], [], [], [], [], 0
            for part in K.slices(batch):
                data, off, _ = K.utf8(part.column(1))
                key, at = shingle_sets(data, off, width)
                node, size = set_digest(key, at), np.diff(at)
                valid = np.asarray(part.column(0).is_valid()) & (size > 0)
                keep, names = [], node.tobytes()
                for k in np.flatnonzero(valid).tolist():
                    if (v := names[16 * k : 16 * k + 16]) not in seen:
                        seen.add(v)
                        keep.append(k)
                if len(seen) > 1 << 19:
                    seen.clear()
                keep = np.array(keep, np.int64)
                if not len(keep):
                    continue
                b = band(size[keep])
                for own in (True, False):
                    # Own band, and the band below for sets that its largest may link with.
                    which = np.arange(len(keep)) if own else np.flatnonzero((b > 0) & (size[keep] * percent <= 100 * (SMALL << np.maximum(b - 1, 0))))
                    scheme = b[which] - (not own)
                    table = {int(v): allocate(band_high(v), percent) for v in np.unique(scheme)}
                    m = np.array([table[int(v)][0] for v in scheme], np.int64)
                    t = np.array([table[int(v)][1] for v in scheme], np.int64)
                    owner, sig, per_set = _segments(key, at, keep[which], m, scheme, t)
                    nodes.append(node[keep[which]])
                    sizes.append(size[keep[which]])
                    known = np.where(t > 0, 0, per_set)
                    segments.append(known if own else -1 - known)
                    owners.append(owner + base)
                    sigs.append(sig)
                    base += len(which)
            if not base:
                continue
            entry = np.empty(base, ENTRY)
            entry["node"], entry["size"], entry["segments"] = np.concatenate(nodes), np.concatenate(sizes), np.concatenate(segments)
            owner, sig = np.concatenate(owners), np.concatenate(sigs)
            slot = ((sig & np.uint64(0xFFFFFFFF)) % np.uint64(slots)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            order = order[np.argsort(slot[order].astype(np.uint16) if slots < 65536 else slot[order], kind="stable")]
            slot, owner, rest = slot[order], owner[order], (sig[order] >> np.uint64(32)).astype(np.uint32)
            cut = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            out = []
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(slot)], strict=True):
                who = owner[a:z]
                begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                out.append((int(slot[a]), entry[who[begin]].tobytes(), np.diff(np.append(begin, z - a)).astype("<u4").tobytes(), rest[a:z].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(arrow_task(run), schema)


MEMBER, STAR = 0, 1
#: Members of a bucket that the others are held against in round one, and how many of them a set is verified against.
LEADERS, STARS = 8, 24
#: How often the sets that take part in round two are counted anew, and the buckets before a bucket that a pair's first meeting is looked for in.
PRUNINGS, LOOK_BACK = 2, 6


def buckets(blocks: DataFrame, slots: int, percent: int) -> DataFrame:
    """Of all signatures that several nodes share, two kinds of rows:

    MEMBER: bucket, node, size, n (segments, as ENTRY has them), and
    STAR: leader (of the bucket), node (another member whose size fits), size, n (how often they meet so), once per slot.
    """
    schema = "kind tinyint, bucket bigint, leader binary, node binary, size int, n int"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        entry = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in table.column("entries")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("counts")])
        sig = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("signatures")])
        who = np.repeat(np.arange(len(entry), dtype=np.int32), counts)
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        same = s[1:] == s[:-1]
        many = np.zeros(len(s), bool)
        many[1:] |= same
        many[:-1] |= same
        order, s = order[many], s[many]
        e = entry[who[order]]
        # A set whose copies came from several tasks counts once in a bucket; the largest set leads.
        hi, lo = e["node"][:, 0], e["node"][:, 1]
        order = np.lexsort((e["segments"] < 0, lo, hi, -e["size"], s))
        e, s = e[order], s[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (e["node"][1:] != e["node"][:-1]).any(axis=1)
        e, s = e[first], s[first]
        begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        n = np.diff(np.append(begin, len(s)))
        keep = np.repeat(n > 1, n)
        bucket = (s[keep].astype(np.int64) << 20 | (slot & 0xFFFFF)) if slots <= 1 << 20 else K.mix64(s[keep].astype(np.uint64) ^ np.uint64(slot << 32)).view(np.int64)
        e = e[keep]
        size = e["size"].astype(np.int64)
        # Nodes as numbers within the slot.
        by = np.lexsort((e["node"][:, 1], e["node"][:, 0]))
        names = e["node"][by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (names[1:] != names[:-1]).any(axis=1)
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(fresh) - 1
        names = names[fresh]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(bucket)))
        stars = []
        for k in range(LEADERS):  # the largest set, then others by chance, the same ones in every bucket that they share
            if k:
                rank = K.mix64(names[:, 0] ^ np.uint64(k))[number]
                order = np.lexsort((rank, np.repeat(np.arange(len(n)), n)))
                head = order[start] if len(start) else start
            else:
                head = start
            lead = np.repeat(head, n)
            ok = (number[lead] != number) & (100 * np.minimum(size, size[lead]) >= percent * np.maximum(size, size[lead]))
            stars.append(np.stack([number[lead][ok], number[ok], size[ok]]))
        sp, sx, ss = np.concatenate(stars, axis=1)
        order = np.lexsort((sx, sp))
        sp, sx, ss = sp[order], sx[order], ss[order]
        begin = np.flatnonzero(np.append(True, (sp[1:] != sp[:-1]) | (sx[1:] != sx[:-1]))) if len(sp) else np.zeros(0, np.int64)
        shared = np.diff(np.append(begin, len(sp)))
        members, ties = len(number), len(begin)
        columns = [
            pa.array(np.repeat([MEMBER, STAR], [members, ties]).astype(np.int8)),
            pa.array(np.concatenate([bucket, np.zeros(ties, np.int64)]), mask=np.arange(members + ties) >= members),
            pa.concat_arrays([pa.nulls(members, pa.binary()), node_names(names[sp[begin]])]),
            node_names(names[np.concatenate([number, sx[begin]])]),
            pa.array(np.concatenate([size, ss[begin]]).astype(np.int32)),
            pa.array(np.concatenate([e["segments"], shared]).astype(np.int32)),
        ]
        end_task()
        return pa.Table.from_arrays(columns, schema=arrow)

    return blocks.repartition(min(slots, MOST_PARTITIONS), "slot").groupBy("slot").applyInArrow(run, schema)


def _bit_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the ids' hashes: 2 MB whatever the number of ids (with very many it lets more through, never less)."""
    h = F.xxhash64("doc_id")
    bits = ids.select(F.explode(F.array(F.pmod(h, F.lit(1 << FILTER_BITS)), F.pmod(F.shiftright(h, 32), F.lit(1 << FILTER_BITS)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("mask"))
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy().astype(np.uint32)
    return out


def _shuffled(df: DataFrame) -> DataFrame:
    """df for joins by shuffle: some ten joins of one call, each with a table just small enough to be broadcast, are too much for a driver."""
    return df.hint("merge")


#: Sets that are verified against one set in one place.
TOGETHER = 128


def _verified(docs: DataFrame, digests: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of nodes (a, b) that link, by their sets. A node may be a in very many pairs, which are dealt out."""
    n = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / TOGETHER).cast("int"))
    dealt = pairs.join(_shuffled(n), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node"))
    heads = n.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
    wanted = written(dealt.unionByName(heads), "wanted")
    nodes = wanted.select("node").distinct()
    reps = written(digests.join(_shuffled(nodes), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "representatives")
    bits = _bit_filter(reps.select("doc_id"))
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))

    def sets(batch):
        h = batch.column(2).to_numpy(zero_copy_only=False)
        maybe = np.ones(len(h), bool)
        for k in (h % (1 << FILTER_BITS), (h >> 32) % (1 << FILTER_BITS)):
            maybe &= (bits[k >> 5] >> (k & 31).astype(np.uint32)) & 1 > 0
        chosen = batch.filter(pa.array(maybe & np.asarray(batch.column(0).is_valid())))
        for part in K.slices(chosen):
            data, off, _ = K.utf8(part.column(1))
            key, at = shingle_sets(data, off, width)
            cut = (at * 8).tolist()
            raw = key.tobytes()
            yield {"node": node_names(set_digest(key, at)), "doc_id": part.column(0), "shingles": [raw[cut[k] : cut[k + 1]] for k in range(part.num_rows)]}

    found = map_arrow(hashed, sets, "node binary, doc_id bigint, shingles binary")
    placed = found.join(_shuffled(wanted.join(_shuffled(reps), "node")), ["node", "doc_id"]).select("a", "part", "node", "shingles")

    def linked(table: pa.Table) -> pa.Table:
        a = table.column("a")[0].as_py()
        every = dict(zip(table.column("node").to_pylist(), (np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")), strict=True))
        p = every.pop(a, np.zeros(0, np.uint64))
        out = []
        for b, q in every.items():
            small, large = (p, q) if len(p) <= len(q) else (q, p)
            if not len(small):
                continue
            same = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            if 100 * same >= percent * (len(p) + len(q) - same):
                out.append(b)
        return pa.table({"a": pa.array([a] * len(out), pa.binary()), "b": pa.array(out, pa.binary())})

    links = written(placed.groupBy("a", "part").applyInArrow(linked, "a binary, b binary"), "links")
    dropped(wanted)
    dropped(reps)
    return links


#: Parts that the neighbours of one node are dealt over at most.
DEALT = 1024


def _smallest(pairs: DataFrame) -> DataFrame:
    """a, b and `low`, the least b of each a. A node may have a third of all pairs: they stay dealt over parts, and the
    parts (at most DEALT a node) meet for the least one only."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(DEALT)))
    parts = dealt.groupBy("a", "part").agg(F.min("b").alias("b"))
    low = parts.join(_shuffled(parts.groupBy("a").agg(F.min("b").alias("low"))), "a").select("a", "part", "low")
    return dealt.join(_shuffled(low), ["a", "part"]).select("a", "b", "low")


def _settled(now: DataFrame) -> bool:
    """Whether edges a-b (a > b) are stars: each a has one b, and no b is an a. Two counts a node, so no key is hot."""
    ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("m")), F.struct(F.col("b").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("m")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("m").alias("m")).filter("n + m > 1 and n > 0").isEmpty()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node and label (the smallest node that edges a-b reach), for nodes with an edge: alternating large and small stars.

    Rounds end when the edges are stars; that takes one shuffle to see, where another round would take a dozen."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    for left in range(most_rounds, -1, -1):
        if _settled(now):
            labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
        if not left:
            break
        # Large star: larger neighbours point to the smallest neighbour (or the node).
        every = _smallest(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = every.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("low", "a").alias("b")).filter("a != b").distinct()
        # Small star: smaller neighbours and the node point to the smallest.
        down = _smallest(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        small = down.select(F.explode(F.array("a", "b")).alias("x"), "low").select(F.col("x").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
        last, now = now, written(small, "edges")
        dropped(last)
    raise RuntimeError(f"components aren't settled after {most_rounds} rounds")


def link_documents(docs: DataFrame, *, width: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digests: doc_id, n_shingles, node; links: a, b between nodes that could join components; labels: node, label)."""

    def digest(batch):
        for part in K.slices(batch):
            data, off, _ = K.utf8(part.column(1))
            key, at = shingle_sets(data, off, width)
            size = np.diff(at)
            b = band(size)
            short = np.zeros(len(size), bool)
            for v in np.unique(b[size > SMALL]):
                which = np.flatnonzero((b == v) & (size > SMALL))
                m, t = allocate(band_high(v), percent)
                _, _, per_set = _segments(key, at, which, np.full(len(which), m), np.full(len(which), v), np.zeros(len(which), np.int64))
                short[which] = per_set < size[which] * (100 - percent) // percent + 1 if not t else False
            sketch = parity_sketch(key, at)
            yield {"doc_id": part.column(0), "n_shingles": size, "node": node_names(set_digest(key, at)), "short": short} | {s: sketch[:, k] for k, s in enumerate(SKETCH)}

    ddl = "doc_id bigint, n_shingles bigint, node binary, short boolean, " + ", ".join(f"{s} bigint" for s in SKETCH)
    digests = written(map_arrow(docs.select("doc_id", "text"), digest, ddl), "digests")
    with_set = digests.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    total = with_set.agg(F.sum("n_shingles").alias("n"), F.count_if("short").alias("short")).first()
    slots = max(LEAST_SLOTS, math.ceil(0.6 * (total["n"] or 0) / SIGNATURES_PER_SLOT))
    found = written(buckets(signature_blocks(docs, slots, width, percent), slots, percent), "buckets")
    members = found.filter(F.col("kind") == MEMBER).select("bucket", "node", "size", (F.col("n") < 0).alias("lower"), F.when(F.col("n") < 0, -1 - F.col("n")).otherwise(F.col("n")).alias("e"))

    # Segments that nobody shares are differences. Most sets have more of them than a link allows (`most`): they need no
    # bucket. In its own band a set counts as the smaller one, in the band below its partner has at most that band's size.
    level = lambda size: F.when(size <= SMALL, 0).otherwise(F.length(F.bin(F.shiftright(size - 1, SMALL.bit_length() - 1))))
    high = F.lit(SMALL) * F.pow(F.lit(2), level(F.col("size")) - 1)
    most = F.when(F.col("lower"), F.floor((F.col("size") + high) * (100 - percent) / (100 + percent))).otherwise(F.floor(F.col("size") * (100 - percent) / percent))
    may = (F.col("e") == 0) | (F.col("e") - F.col("multi") <= F.col("most"))
    counted = W.partitionBy("node", "lower")  # at most a set's segments
    live = written(members.withColumn("multi", F.count("*").over(counted)).withColumn("most", most.cast("int")).filter(may).drop("multi"), "indexed")
    own = live.filter("not lower").groupBy("node").agg(F.first(F.col("e") - F.col("most") - 1).alias("slack"))

    # Written, so that the joins with it have two plain shuffles, whose hot keys the adaptive planner can split.
    sketches = written(with_set.groupBy("node").agg(F.first("n_shingles").alias("size"), *(F.first(s).alias(s) for s in SKETCH)), "sketches")
    of = lambda x: sketches.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), *(F.col(s).alias(f"{x}_{s}") for s in SKETCH))

    # Round one: each such set against the leaders that it meets most often.
    stars = found.filter(F.col("kind") == STAR).groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.sum("n").alias("n"))
    stars = stars.join(_shuffled(own.withColumnRenamed("node", "b")), "b").filter(F.col("n") > F.col("slack") / 2)
    stars = stars.join(_shuffled(of("a")), "a").join(_shuffled(of("b")), "b").filter(_may_link(percent)).select("a", "b", "n")
    best = F.row_number().over(W.partitionBy("b").orderBy(F.desc("n"), "a"))
    pairs = stars.withColumn("nth", best).filter(F.col("nth") <= STARS).select("a", "b")
    if total["short"]:
        pairs = pairs.unionByName(_pairs_of_short_sets(digests, percent)).distinct()
    pairs = written(pairs, "pairs")
    dropped(found)
    links = _verified(docs, with_set, pairs, width, percent)
    labels = components(links)

    # Round two: buckets whose members are in different components.
    open_ = live.join(_shuffled(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    for k in range(PRUNINGS):
        mixed = open_.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.min("lower").alias("probes"))
        mixed = mixed.filter("lo != hi and not probes").select("bucket", "n")
        last, open_ = open_, open_.select("bucket", "node", "size", "lower", "e", "most", "label").join(_shuffled(mixed), "bucket").withColumn("multi", F.count("*").over(counted))
        open_ = written(open_.filter(may), "open")
        if k:
            dropped(last)
    # Fewest members first. How many of its buckets a set needs, for a partner that differs in d shingles: d + 1 less its private segments.
    ordered = counted.orderBy("n", "bucket")
    open_ = open_.withColumn("nth", F.row_number().over(ordered)).withColumn("past", F.collect_list("bucket").over(ordered.rowsBetween(-LOOK_BACK, -1)))
    private = F.when((F.col("e") > 0) & ~F.col("lower"), F.col("e") - F.col("multi"))
    open_ = open_.withColumn("private", private).withColumn("short_of", F.when(F.col("e") == 0, -1_000_000).otherwise(F.col("nth") - 1 + F.col("e") - F.col("multi")))
    # In a band either set of a pair may index the other: the one with more signatures of its own does, as it needs fewer
    # buckets. Across bands the smaller set is the index.
    index = open_.filter("not lower and short_of <= most").select("bucket", "short_of", "private", F.col("past").alias("past_b"), F.col("node").alias("b"), F.col("label").alias("label_b")).join(_shuffled(of("b")), "b")
    probe = open_.select("bucket", F.col("private").alias("private_a"), F.col("past").alias("past_a"), F.col("node").alias("a"), F.col("label").alias("label_a")).join(_shuffled(of("a")), "a")
    alike = level(F.col("size_a")) == level(F.col("size_b"))
    more_own = (F.col("private") > F.col("private_a")) | ((F.col("private") == F.col("private_a")) & (F.col("b") < F.col("a")))
    leads = F.when(F.col("private").isNull() | ~alike, F.col("size_a") >= F.col("size_b")).otherwise(F.coalesce(more_own, F.lit(False)))
    fits = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    enough = F.col("short_of") <= F.floor((F.col("size_a") + F.col("size_b")) * (100 - percent) / (100 + percent))
    i, p = index.alias("i"), _shuffled(probe.alias("p"))
    more = i.join(p, (F.col("i.bucket") == F.col("p.bucket")) & (F.col("label_a") != F.col("label_b")) & leads & fits & enough & _may_link(percent) & ~F.arrays_overlap("past_a", "past_b"))
    # Of two sets of one size each may have indexed the other.
    more = more.select(F.when(F.col("size_a") == F.col("size_b"), F.greatest("a", "b")).otherwise(F.col("a")).alias("a"), F.when(F.col("size_a") == F.col("size_b"), F.least("a", "b")).otherwise(F.col("b")).alias("b")).distinct()
    more = written(more.join(_shuffled(pairs), ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        again = _verified(docs, with_set, more, width, percent)
        if not again.isEmpty():
            links = links.unionByName(again)
            labels = components(links)
    for done in (pairs, live, open_, more, sketches):
        dropped(done)
    return digests, links, labels


def _pairs_of_short_sets(digests: DataFrame, percent: int) -> DataFrame:
    """Pairs of the few sets that have fewer non-empty segments than they need (one in 10^10) with all sets of fitting size."""
    short = digests.filter("short").select(F.col("node").alias("b"), F.col("n_shingles").alias("size_b")).distinct()
    every = digests.filter("n_shingles > 0").select(F.col("node").alias("a"), F.col("n_shingles").alias("size_a")).distinct()
    fits = (F.col("size_a") * 100 >= F.col("size_b") * percent) & (F.col("size_b") * 100 >= F.col("size_a") * percent)
    return every.join(short, fits).filter("a != b").select("a", "b")


def component_table(docs: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, and the number of documents with the very same set.

    Components, not links: pairs that can't join components any more are never verified, so the links
    of a document are not counted."""
    digests, _, labels = link_documents(docs, width=width, percent=percent)
    labelled = digests.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    labelled = labelled.join(_shuffled(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    of_node = labelled.join(_shuffled(lowest), "label").select("node", "component_id", "copies")
    # A node may have a third of all documents: its row is there for each salt.
    salted = of_node.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    own = digests.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int")).join(_shuffled(salted), ["node", "salt"], "left")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return own.select("doc_id", "n_shingles", F.when(known, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(known, F.col("copies")).otherwise(F.lit(0)).alias("copies"))


def keep_first(docs: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """The documents, all their columns, with one row (of the smallest doc_id) of each component.

    Rows are judged one by one: a doc_id with different texts may stay with one and go with another;
    of a component's rows with the smallest doc_id, repeated or not, one stays. Rows without a set or
    without doc_id all stay.
    """
    digests, _, labels = link_documents(docs, width=width, percent=percent)
    labelled = digests.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("node").agg(F.min("doc_id").alias("low"))
    labelled = labelled.join(_shuffled(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = labelled.groupBy("label").agg(F.min(F.struct("low", "node")).alias("first"))
    ids = digests.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter("n > 1").isEmpty():
        stays = first.select(F.col("first.low").alias("doc_id"))
        gone = digests.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).select("doc_id").join(_shuffled(stays), "doc_id", "left_anti")
        gone = gone.select(F.col("doc_id").alias("corvane_gone"))
        return docs.join(_shuffled(gone), docs["doc_id"] == F.col("corvane_gone"), "left_anti")
    at = docs.columns.index("text")

    def own_set(batch):
        for part in K.slices(batch, "text"):
            data, off, _ = K.utf8(part.column(at))
            key, ends = shingle_sets(data, off, width)
            node = pa.compute.if_else(pa.array(np.diff(ends) > 0), node_names(set_digest(key, ends)), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*part.columns, node], names=[*part.schema.names, "corvane_node"])

    rows = map_arrow(docs, own_set, T.StructType([*docs.schema.fields, T.StructField("corvane_node", T.BinaryType())]))
    known = F.col("doc_id").isNotNull() & F.col("corvane_node").isNotNull()
    stays = first.select(F.col("first.low").alias("corvane_low"), F.col("first.node").alias("corvane_first"))
    one = rows.filter(known).join(stays, (F.col("doc_id") == F.col("corvane_low")) & (F.col("corvane_node") == F.col("corvane_first")), "left_semi")
    one = one.withColumn("corvane_nth", F.row_number().over(W.partitionBy("doc_id", "corvane_node").orderBy(F.xxhash64("text")))).filter("corvane_nth = 1")
    return rows.filter(~known).select(*docs.columns).unionByName(one.select(*docs.columns))

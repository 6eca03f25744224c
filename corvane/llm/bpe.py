"""Byte-level BPE encoding and decoding on padded numpy matrices.

A batch of texts is cut into pieces by the pre-tokenizer pattern, evaluated as array operations
on character classes. Pieces that a worker hasn't met yet are gathered in length buckets, padded
to matrices, and every row merges its leftmost pair of minimum rank in each round; pairs are
looked up in a hash table, and each round compacts the rows. Known pieces are found by hash.

Null texts encode like empty ones (no ids). Texts of any length are encoded whole; memory grows
with the longest text. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import kept_by, map_arrow

LETTER, DIGIT, BLANK, OTHER = 0, 1, 2, 3

#: Code points of Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: What may follow an apostrophe that begins a piece, in the pattern's order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Pieces, and bytes of them, that a worker remembers before it starts anew.
CACHE_PIECES, CACHE_BYTES = 1 << 19, 8 << 20


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of each code point: \\p{L}, \\p{N}, \\s or another."""
    try:
        import regex

        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                lo, hi = ord(m[0][0]), ord(m[0][-1])
                out[lo : hi + 1] = kind
        out[0xD800:0xE000] = OTHER
    except ImportError:
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        out = np.array([{"L": LETTER, "N": DIGIT}.get(k, OTHER) for k in kinds], np.uint8)
    out[WHITE_SPACE] = BLANK
    return out


def pieces(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in documents that lie one after another; off: document offsets.

    The pattern: contractions, then letters, digits or other signs with an optional leading space,
    then blanks, of which the last before a solid character stands alone.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[codes]
    first = np.zeros(n + 1, bool)
    first[off[off <= n]] = True
    first[n] = True
    edge = first.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    start = edge[:n].copy()
    blank, space = kind == BLANK, codes == 32
    # A run of blanks before a solid character of the same document gives its last one away.
    gives = np.zeros(n, bool)
    gives[:-1] = blank[:-1] & edge[1:n] & ~first[1:n]
    start |= gives
    joined = np.flatnonzero(gives & space) + 1  # runs that begin with that space
    start[joined] = False
    # Contractions: a lone apostrophe that begins a piece, then letters.
    apostrophe = np.flatnonzero((codes[:-1] == 39) & start[:-1] & edge[1:n] & ~first[1:n] & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
    if len(apostrophe):
        a = apostrophe + 1
        c0 = codes[a]
        has2 = (a + 1 < n) & ~edge[np.minimum(a + 1, n)]
        c1 = np.where(has2, codes[np.minimum(a + 1, n - 1)], 0)
        length = np.zeros(len(a), np.int64)
        for tail in CONTRACTIONS[::-1]:
            hit = (c0 == ord(tail[0])) & ((c1 == ord(tail[1])) if len(tail) > 1 else True)
            length[hit] = len(tail)
        a, length = a[length > 0], length[length > 0]
        start[a] = False
        after = a + length
        start[after[after < n]] = True
    return np.flatnonzero(start)


_NEVER = np.int64(1 << 40)


class RankTable:
    """Mergeable pairs by a hash of both ids; merges of a pair's tokens give the token whose rank is lowest."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = sorted(ranks, key=ranks.get)
        left, right, made = [], [], []
        for t in tokens:
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(ranks[t])
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        self.made = np.array(made, np.int64)
        self.index = K.HashIndex(max(8, int(len(keys) * 2).bit_length()))
        self.index.add(keys.astype(np.uint64))
        lengths = np.zeros(self.size, np.int64)
        for t, r in ranks.items():
            lengths[r] = len(t)
        self.length = lengths
        self.at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        blob = bytearray(int(lengths.sum()))
        for t, r in ranks.items():
            blob[self.at[r] : self.at[r] + len(t)] = t
        self.blob = np.frombuffer(bytes(blob), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = self.index.find((a * self.size + b).astype(np.uint64).ravel()).reshape(a.shape)
        return np.where(got >= 0, self.made[got], _NEVER)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, one after another."""
        return self.blob[K.ranges(self.at[ids], self.length[ids])]


def merge_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: RankTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each span of bytes, one after another, and how many each has."""
    sizes = np.zeros(len(starts), np.int64)
    bucket = np.maximum(3, np.ceil(np.log2(np.maximum(lengths, 1)))).astype(np.int64)
    found = []
    for k in np.unique(bucket):
        members = np.flatnonzero(bucket == k)
        step = max(1, (1 << 19) >> int(k))
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            n, wide = lengths[part], int(lengths[part].max(initial=1))
            ids = np.full((len(part), wide), -1, np.int64)
            real = np.arange(wide) < n[:, None]
            ids[real] = table.byte_id[data[K.ranges(starts[part], n)]]
            merged = _merge_matrix(ids, n, table)
            real = merged >= 0
            sizes[part] = real.sum(axis=1)
            found.append((part, merged[real]))
    at = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.uint32)
    for part, ids in found:
        flat[K.ranges(at[part], sizes[part])] = ids
    return flat, sizes


def _merge_matrix(ids: np.ndarray, lengths: np.ndarray, table: RankTable) -> np.ndarray:
    """Rows padded with -1; each round merges every row's leftmost pair of minimum rank and closes the gap."""
    out = np.full(ids.shape, -1, np.int64)
    owner, wide = np.arange(len(ids)), ids.shape[1]
    ranks = np.full((len(ids), max(wide, 2)), _NEVER)  # ranks[:, k]: of the pair at k; the last column stays empty
    if wide > 1:
        real = ids[:, 1:] >= 0
        ranks[:, : wide - 1][real] = table.rank(ids[:, :-1][real], ids[:, 1:][real])
    while len(owner):
        at = ranks.argmin(axis=1)
        low = ranks[np.arange(len(owner)), at]
        done = low >= _NEVER
        if done.any():
            out[owner[done], : ids.shape[1]] = ids[done]
            keep = ~done
            owner, ids, ranks, at, low = owner[keep], ids[keep], ranks[keep], at[keep], low[keep]
            if not len(owner):
                break
            wide = int((ids >= 0).sum(axis=1).max())
            ids, ranks = ids[:, :wide], ranks[:, : max(wide, 2)]
        if wide > 64:
            ids, ranks = _merge_further(ids, ranks, low, table)
            continue
        rows = np.arange(len(owner))
        ids[rows, at] = low
        shift = np.arange(wide) + (np.arange(wide) > at[:, None])
        pad = shift >= wide
        shift[pad] = wide - 1
        ids, ranks = np.take_along_axis(ids, shift, axis=1), np.take_along_axis(ranks, shift, axis=1)
        ids[pad], ranks[pad] = -1, _NEVER
        for side in (at - 1, at):
            ok = side >= 0
            r, c = rows[ok], side[ok]
            a, b = ids[r, c], ids[r, np.minimum(c + 1, wide - 1)]
            ranks[r, c] = np.where((b >= 0) & (c + 1 < wide), table.rank(a, np.maximum(b, 0)), _NEVER)
    return out


def _merge_further(ids: np.ndarray, ranks: np.ndarray, low: np.ndarray, table: RankTable) -> tuple[np.ndarray, np.ndarray]:
    """As many rounds at once as have the same minimum: each row merges its leftmost place, and the next ones up to the
    first that makes a pair of lower rank, which would come before the rest."""
    wide = ids.shape[1]
    here = _apart(ranks[:, :wide] == low[:, None])
    r, c = np.nonzero(here)
    t = low[r]
    left = np.where(c > 0, ids[r, np.maximum(c - 1, 0)], -1)
    left = np.where((c > 1) & here[r, np.maximum(c - 2, 0)], t, left)  # that place is merged by then
    right = np.where(c + 2 < wide, ids[r, np.minimum(c + 2, wide - 1)], -1)
    lower = np.zeros(len(r), bool)
    for ok, a, b in ((left >= 0, left, t), (right >= 0, t, right)):
        lower[ok] |= table.rank(a[ok], b[ok]) < t[ok]
    before = np.cumsum(lower) - lower
    go = before == before[np.searchsorted(r, r)]
    r, c = r[go], c[go]
    ids[r, c] = low[r]
    ids[r, c + 1] = -1
    order = np.argsort(ids < 0, axis=1, kind="stable")
    ids = np.take_along_axis(ids, order, axis=1)
    ranks = np.full(ids.shape, _NEVER)
    real = ids[:, 1:] >= 0
    ranks[:, :-1][real] = table.rank(ids[:, :-1][real], ids[:, 1:][real])
    return ids, ranks


def _apart(here: np.ndarray) -> np.ndarray:
    """Of touching places in a row the first, third and so on."""
    run = np.zeros(here.shape, np.int32)
    r, c = np.nonzero(here)
    if not len(r):
        return here
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
    run[r, c] = (np.arange(len(r)) - begin) % 2 + 1
    return run == 1


class Encoder:
    """Encodes batches of texts; pieces met before are found by hash, and their bytes are compared."""

    def __init__(self, merge, table: RankTable | None = None):
        """merge: from bytes, starts and lengths of spans to their ids and how many each has."""
        self.merge, self.table = merge, table
        self._forget()

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Encoder:
        table = RankTable(ranks)
        return cls(lambda data, starts, lengths: merge_spans(data, starts, lengths, table), table)

    def _forget(self) -> None:
        self.known = K.HashIndex(18)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0  # ids of the pieces
        self.raw, self.held = np.zeros(1 << 20, np.uint8), 0  # bytes of the pieces
        self.at, self.size, self.raw_at, self.length = (np.zeros(1 << 17, np.int64) for _ in range(4))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None) -> np.ndarray:
        """Numbers of new pieces; without keys they won't be found again."""
        length = ends - starts
        flat, sizes = self.merge(data, starts, length)
        numbers = self.known.skip(len(starts)) if keys is None else self.known.add(keys)
        total = int(length.sum())
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.held + total > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        while self.known.count > len(self.at):
            self.at, self.size, self.raw_at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.raw_at, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        self.raw[self.held : self.held + total] = data[K.ranges(starts, length)]
        self.at[numbers], self.size[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.raw_at[numbers], self.length[numbers] = self.held + np.cumsum(length) - length, length
        self.used += len(flat)
        self.held += total
        return numbers

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents and their offsets per document."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        codes = K.codepoints(data)
        ascii_only = len(codes) == len(data)
        char_off = off if ascii_only else K.char_offsets(data, off)
        starts = pieces(codes, char_off)
        del codes
        if not ascii_only:
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            starts = lead[starts]
        ends = np.append(starts[1:], len(data))
        length = ends - starts
        keys = K.span_hash(data, starts, ends)
        if self.known.count > CACHE_PIECES or self.held > CACHE_BYTES:
            self._forget()
        got = self.known.find(keys)
        new = np.flatnonzero(got < 0)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            first = new[first]
            self._learn(data, starts[first], ends[first], distinct)
            got[new] = self.known.find(keys[new])
        # Equal hashes of other bytes: those pieces are encoded for themselves. Up to 8 bytes of one length the hash tells all.
        alike = self.length[got] == length
        deep = np.flatnonzero(alike & (length > 8))
        alike[deep] = K.same_bytes(data, starts[deep], self.raw, self.raw_at[got[deep]], length[deep])
        if not alike.all():
            other = np.flatnonzero(~alike)
            got[other] = self._learn(data, starts[other], ends[other], None)
        sizes = self.size[got]
        ids = self.flat[K.ranges(self.at[got], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[np.searchsorted(starts, off)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


_encoders: dict[str, Encoder] = {}
kept_by("bpe", _encoders.clear)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file that every machine has at this path."""
    if path not in _encoders:
        with open(path, "rb") as f:
            _encoders[path] = Encoder.of_ranks(read_ranks(f.read()))
    return _encoders[path]


def encode_documents(docs: DataFrame, vocabulary: str, *, decode: bool = True, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), and decoded (the bytes of the ids again)."""
    fields = ["doc_id bigint", "n_tokens bigint"] + ["ids array<int>"] * with_ids + ["decoded binary"] * decode

    def run(batch):
        enc = encoder(vocabulary)
        for part in K.slices(batch):
            data, off, _ = K.utf8(part.column(1))
            ids, at = enc.encode(data, off)
            out = {"doc_id": part.column(0), "n_tokens": np.diff(at)}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            if decode:
                back, cut = enc.table.decode(ids), np.concatenate([[0], np.cumsum(enc.table.length[ids])])[at]
                out["decoded"] = pa.array([back[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())
            yield out

    return map_arrow(docs.select("doc_id", "text"), run, ", ".join(fields), "bpe")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids and decoded bytes stay in the worker."""

    def run(batch):
        enc = encoder(vocabulary)
        for part in K.slices(batch):
            data, off, _ = K.utf8(part.column(1))
            ids, at = enc.encode(data, off)
            cut = np.concatenate([[0], np.cumsum(enc.table.length[ids])])[at].tolist()
            raw, back, at4 = ids.astype("<u4").tobytes(), enc.table.decode(ids).tobytes(), (at * 4).tolist()
            n = part.num_rows
            yield {
                "doc_id": part.column(0),
                "n_tokens": np.diff(at),
                "ids_sha256": [hashlib.sha256(raw[at4[k] : at4[k + 1]]).hexdigest() for k in range(n)],
                "decoded_sha256": [hashlib.sha256(back[cut[k] : cut[k + 1]]).hexdigest() for k in range(n)],
            }

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "bpe")

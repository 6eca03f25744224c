"""Vectorised text kernels over Arrow string columns (numpy only, no Spark).

Texts are looked at as one flat byte (or code point) buffer with document offsets, so the cost
is a few array passes a character whatever the number of documents. Spans (words, pieces) have
64-bit hashes; where equal hashes must mean equal bytes the callers compare them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text, and rows, that one slice holds, so that temporaries stay within tens of MB.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 4096

#: Bytes of a span that are hashed one block of 8 after another; longer spans are hashed by their chunks' hashes.
CHUNK = 128

#: ASCII white space: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1) and the mask of non-null rows of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    if not valid.all():
        column = column.fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0], valid


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES):
    """Slices of a record batch whose texts hold about `most` bytes; one row at least."""
    if not batch.num_rows:
        return
    _, off, _ = utf8(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + SLICE_ROWS, max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document counts of the words `[^\\x20\\x09-\\x0D]+`."""
    n = len(data)
    solid = np.empty(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(SPACE[data], out=solid[1:-1])
    inner = solid[1:-1]
    begin = inner & ~solid[:-2]
    cut = off[:-1][off[:-1] < n]
    begin[cut] = inner[cut]
    starts = np.flatnonzero(begin)
    end = inner & ~solid[2:]
    last = off[1:][off[1:] > 0] - 1
    end[last] = inner[last]
    ends = np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, off))
    return starts, ends, counts


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for each span; equal spans hash alike anywhere.

    Blocks of 8 bytes are mixed in one after another, so no structure of the text survives. Of two spans of
    one length of at most 8 bytes the hashes differ if the spans do.
    """
    size = values.dtype.itemsize
    if size > 1:
        values, starts, ends = np.ascontiguousarray(values).view(np.uint8), starts * size, ends * size
    length = ends - starts
    deep = length > CHUNK
    if not deep.any():
        return _block_hash(values, starts, length)
    out = np.empty(len(starts), np.uint64)
    flat = ~deep
    out[flat] = _block_hash(values, starts[flat], length[flat])
    n = -(-length[deep] // CHUNK)
    nth = ranges(np.zeros(len(n), np.int64), n)
    begin = np.repeat(starts[deep], n) + nth * CHUNK
    chunks = _block_hash(values, begin, np.minimum(np.repeat(ends[deep], n) - begin, CHUNK))
    at = np.concatenate([[0], np.cumsum(n)])
    out[deep] = mix64(span_hash(chunks, at[:-1], at[1:]) ^ mix64(length[deep].astype(np.uint64)))
    return out


def _block_hash(values: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    h = mix64(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    most = int(length.max(initial=0))
    if not most:
        return h
    padded = np.zeros(len(values) + 8, np.uint8)
    padded[: len(values)] = values
    eight = np.ndarray(len(values) + 1, "<u8", padded, strides=(1,))
    live = slice(None)
    for k in range(0, most, 8):
        if k:
            live = np.flatnonzero(length > k)
        left = length[live] - k
        block = eight[starts[live] + k] & _LOW_BYTES[np.minimum(left, 8)]
        h[live] = mix64((h[live] ^ block) + np.uint64(k))
    return h


#: Masks of the lowest 0 to 8 bytes.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[start : start + length] and b[start : start + length] hold the same bytes, by span."""
    out = np.ones(len(length), bool)
    differ = a[ranges(a_starts, length)] != b[ranges(b_starts, length)]
    if differ.any():
        out[np.repeat(np.arange(len(length)), length)[differ]] = False
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class HashIndex:
    """Open-addressing map from uint64 keys to their number in order of insertion."""

    def __init__(self, bits: int = 16):
        self.count = 0
        self._new(bits)

    def _new(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.full(1 << bits, -1, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 where there is none."""
        at = self._home(keys)
        got = self.slots[at]
        out = np.where((got >= 0) & (self.keys[at] == keys), got, np.int64(-1))
        todo = np.flatnonzero((got >= 0) & (out < 0))
        at, mask = at[todo], (1 << self.bits) - 1
        while len(todo):
            at = (at + 1) & mask
            sub, got = keys[todo], self.slots[at]
            hit = (got >= 0) & (self.keys[at] == sub)
            out[todo[hit]] = got[hit]
            left = (got >= 0) & ~hit
            todo, at = todo[left], at[left]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Inserts distinct new keys; returns their numbers."""
        while (self.count + len(keys)) * 2 > (1 << self.bits):
            old_keys, old_slots = self.keys[self.slots >= 0], self.slots[self.slots >= 0]
            self._new(self.bits + 1)
            self._put(old_keys, old_slots)
        numbers = np.arange(self.count, self.count + len(keys), dtype=np.int64)
        self._put(keys, numbers)
        self.count += len(keys)
        return numbers

    def skip(self, n: int) -> np.ndarray:
        """Numbers that no key has."""
        self.count += n
        return np.arange(self.count - n, self.count, dtype=np.int64)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[todo[free]]  # of those that share a slot the last stays
            self.keys[at[free]] = keys[todo[free]]
            placed = self.slots[at] == numbers[todo]
            self.keys[at[placed]] = keys[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & mask


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def codepoints(data: np.ndarray) -> np.ndarray:
    """Code points of valid UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def char_offsets(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets turned into code point offsets."""
    lead = np.empty(len(data) + 1, np.int64)
    lead[0] = 0
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return lead[off]

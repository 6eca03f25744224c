"""Source divergence audit: how the sources of a language differ in the words they use.

Two passes over whole texts. The first counts exact document frequencies, added up in the task and then by Spark; each
language keeps the terms of at least `least_docs` of its documents. The second pass recounts occurrences with
Aho-Corasick automata (pyahocorasick) of the kept terms, each padded with the delimiter, over texts whose
delimiters are all spaces: so a match is a whole term. A language's vocabulary is cut to blocks of about BLOCK terms, one
automaton each; with more than one block a text's terms go each to its own block, so texts are sent once whatever the
number of blocks. Counts by language, source and term are the postings. Everything after them works on postings and groups:
shares of a term are compared with the language's for the ranks of terms; pairs of sources meet in cells of two
blocks of sources and one shard of terms, where terms that neither side has aren't looked at: what they
add is the same for all and is put in afterwards by their number.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z in lower case. Null text, lang and source read as ''. Each row is a document, repeated rows too. Every (lang, source) that
occurs is a group, even without terms; a source alone in its language has no pairs; a language without kept terms has pairs of
value 0 and no terms. All arithmetic is on whole numbers. Ties go to the smaller item by its UTF-8 bytes. Empty tables give no
rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import kernels as K
from .common import arrow_task, map_arrow, written

#: Bytes of a vocabulary that is sent to all tasks.
BROADCAST_BYTES = 32 << 20
#: Terms of an automaton, terms of a shard and sources of a block in the comparison of pairs.
BLOCK, TERMS, SOURCES = 50_000, 4096, 128
#: Terms, cells (of a source and a term) and bytes of text that a task holds.
HELD_COUNTS, HELD_CELLS, HELD_BYTES = 1_000_000, 4_000_000, 4 << 20

#: Delimiters become spaces, A-Z lower case, other bytes stay.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

PLAIN_BYTES = np.frombuffer(PLAIN, np.uint8)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).alias("text"))


def _plain(texts: pa.Array) -> list[bytes]:
    """Texts with spaces for delimiters, in lower case."""
    return [t.translate(PLAIN) for t in texts.cast(pa.binary()).to_pylist()]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of x in order, and how often each occurs."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.concatenate([at, [len(x)]]))


class DocumentCounts:
    """In how many documents of each language terms occur. Terms are found by 64-bit hashes and compared by their bytes;
    what differs from the term of its hash is counted apart, so counts are exact."""

    def __init__(self) -> None:
        self.index = K.HashIndex()
        self.text, self.used = np.zeros(1 << 16, np.uint8), 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n: dict[str, np.ndarray] = {}
        self.apart: dict[str, Counter] = defaultdict(Counter)

    def _numbers(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for a word that isn't the term of its hash."""
        h = K.span_hash(data, starts, starts + lengths)
        ids = self.index.find(h)
        new = np.flatnonzero(ids < 0)
        if len(new):
            new = new[np.argsort(h[new], kind="stable")]
            first = np.concatenate([[True], h[new][1:] != h[new][:-1]])
            at = new[first]
            ids[new] = self.index.add(h[at])[np.cumsum(first) - 1]
            more = data[K.ranges(starts[at], lengths[at])]
            while self.used + len(more) > len(self.text):
                self.text = np.concatenate([self.text, np.zeros(len(self.text), np.uint8)])
            self.text[self.used : self.used + len(more)] = more
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths[at]) - lengths[at]])
            self.lengths = np.concatenate([self.lengths, lengths[at]])
            self.used += len(more)
        same = self.lengths[ids] == lengths
        long = np.flatnonzero(same & (lengths > 8))  # shorter ones of one length and hash are equal
        same[long] = K.same_bytes(data, starts[long], self.text, self.starts[ids[long]], lengths[long])
        return np.where(same, ids, -1)

    def add(self, langs: list[str], data: np.ndarray, off: np.ndarray) -> None:
        """Texts as bytes whose delimiters are spaces."""
        starts, ends, counts = K.words(data, off)
        if not len(starts):
            return
        ids = self._numbers(data, starts, ends - starts)
        doc = np.repeat(np.arange(len(langs)), counts)
        rows = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        row = np.array([rows[x] for x in langs], np.int64)
        known = ids >= 0
        once, _ = _runs((doc[known] << 32) | ids[known])  # a term counts once in a document
        flat, n = _runs((row[once >> 32] << 32) | (once & 0xFFFFFFFF))
        for lang, i in rows.items():
            lo, hi = np.searchsorted(flat, [i << 32, (i + 1) << 32])
            if lo < hi:
                held = self.n.get(lang, np.zeros(0, np.int64))
                if len(held) < self.index.count:
                    held = np.concatenate([held, np.zeros(2 * self.index.count - len(held), np.int64)])
                held[flat[lo:hi] & 0xFFFFFFFF] += n[lo:hi]
                self.n[lang] = held
        for d, word in {(d, data[a:z].tobytes()) for d, a, z in zip(doc[~known], starts[~known], ends[~known], strict=True)}:
            self.apart[langs[d]][word] += 1

    def batches(self):
        for lang, n in self.n.items():
            ids = np.flatnonzero(n)
            at = np.concatenate([[0], np.cumsum(self.lengths[ids])])
            text = self.text[K.ranges(self.starts[ids], self.lengths[ids])]
            yield lang, pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text)]), n[ids]
        for lang, found in self.apart.items():
            yield lang, pa.array(list(found), pa.binary()), np.array(list(found.values()), np.int64)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, n_docs: the exact number of the language's documents that hold the term."""

    def run(batches):
        held = DocumentCounts()

        def out():
            for lang, terms, n in held.batches():
                names = [t.decode("utf-8", "replace") for t in terms.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(n, pa.int64())], ["lang", "term", "n_docs"])

        for batch in batches:
            for part in K.slices(batch):
                data, off, _ = K.utf8(part.column(1))
                held.add(part.column(0).to_pylist(), PLAIN_BYTES[data], off)
                if held.index.count >= HELD_COUNTS:
                    yield from out()
                    held = DocumentCounts()
        yield from out()

    found = _texts(docs).select("lang", "text").mapInArrow(arrow_task(run), "lang string, term string, n_docs bigint")
    return found.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))


def _streams(docs: DataFrame, blocks: int) -> DataFrame:
    """lang, block, sources, lengths, stream: texts of one language side by side, by source, each ended by a space and
    only with the terms of one block."""

    def run(batches):
        held: dict[tuple, list[bytes]] = defaultdict(list)
        size = 0

        def out():
            rows = defaultdict(list)
            for (lang, block, source), texts in held.items():
                rows[lang, block].append((source, b" ".join(texts)))
            for (lang, block), parts in rows.items():
                sources, streams = zip(*parts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([block], pa.int32()), pa.array([sources], pa.list_(pa.string())), pa.array([[len(x) for x in streams]], pa.list_(pa.int64())), pa.array([b"".join(streams)], pa.binary())], ["lang", "block", "sources", "lengths", "stream"])

        for batch in batches:
            for part in K.slices(batch):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _plain(part.column(2)), strict=True):
                    if blocks == 1:
                        held[lang, 0, source].append(text)
                    else:
                        terms = [t.decode("utf-8", "replace").encode() for t in text.split()]
                        by = [zlib.crc32(t) % blocks for t in terms]
                        for b in set(by):
                            held[lang, b, source].append(b" ".join([t for t, x in zip(terms, by, strict=True) if x == b]))
                    size += len(text)
                    if size >= HELD_BYTES:
                        yield from out()
                        held.clear()
                        size = 0
        yield from out()

    return _texts(docs).mapInArrow(arrow_task(run), "lang string, block int, sources array<string>, lengths array<bigint>, stream binary")


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(f" {t} ", i)
    found.make_automaton()
    return found


def occurrences(found: ahocorasick.Automaton, text: bytes, terms: int) -> np.ndarray:
    """How often each of the terms (by number) stands in text, whose delimiters are spaces."""
    return np.bincount(np.fromiter(map(itemgetter(1), found.iter(f" {text.decode('utf-8', 'replace')} ")), np.int64), minlength=terms)


def recount(docs: DataFrame, vocabulary: DataFrame, blocks: int) -> DataFrame:
    """lang, source, term, n: occurrences of the kept terms (lang, term)."""
    block = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(blocks)).cast("int")
    terms = vocabulary.groupBy("lang", block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("terms"))  # about BLOCK of them
    terms = written(terms, "vocabulary-blocks")
    size = terms.agg(F.sum(F.octet_length("terms")).alias("n")).first()["n"] or 0  # one number
    if size <= BROADCAST_BYTES:  # texts stay where they are; a larger vocabulary is shuffled with them
        terms = F.broadcast(terms)
    met = _streams(docs, blocks).join(terms, ["lang", "block"]).select("lang", "block", "sources", "lengths", "stream", "terms")

    def run(batches):
        made: dict[tuple, tuple] = {}  # names and automaton of a block
        held: dict[tuple, dict[str, np.ndarray]] = defaultdict(dict)  # counts by block and source
        size = 0

        def out():
            for block, sources in held.items():
                names = np.array(made[block][0], object)
                for source, n in sources.items():
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([block[0]] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(names[at], pa.string()), pa.array(n[at], pa.int64())], ["lang", "source", "term", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                lang, block, sources, lengths, stream, words = (batch.column(j)[i].as_py() for j in range(6))
                if (lang, block) not in made:
                    names = words.split(" ")
                    made[lang, block] = names, automaton(names)
                names, found = made[lang, block]
                at, own = 0, held[lang, block]
                for source, length in zip(sources, lengths, strict=True):
                    n = occurrences(found, stream[at : at + length], len(names))
                    size += 0 if source in own else len(names)
                    own[source] = own[source] + n if source in own else n
                    at += length
                if size >= HELD_CELLS or sum(len(x) for x, _ in made.values()) > 4 * BLOCK:
                    yield from out()
                    made.clear()
                    held.clear()
                    size = 0
        yield from out()

    counted = met.mapInArrow(arrow_task(run), "lang string, source string, term string, n bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (n + 5) / (total + 5 * terms)), on whole numbers of any size."""
    whole = lambda c: c.cast("decimal(20,0)")
    top = whole(n + 5) * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", top, whole(total + 5 * terms)) + 1


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, a, b, value (a < b): the sum over all kept terms of the difference of shares. groups: lang, source, zero
    (the share of a term without occurrences), v; shares: lang, source, term, p of the occurring ones."""
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("parts"), F.greatest(F.ceil(F.max("v") / TERMS), F.lit(1)).alias("shards"))
    part = F.pmod(F.xxhash64("source"), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda o: F.struct(F.least(F.col("part"), o).alias("i"), F.greatest(F.col("part"), o).alias("j")))
    member = groups.join(langs, "lang").withColumn("part", part).withColumn("cell", F.explode(cells))
    member = member.select("lang", "cell.*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), "source", "zero", (F.col("part") == F.col("cell.i")).alias("left"), (F.col("part") == F.col("cell.j")).alias("right"))
    posting = shares.join(langs, "lang").withColumn("part", part).withColumn("cell", F.explode(cells))
    posting = posting.select("lang", "cell.*", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), "source", "term", "p")

    def run(key, sources: pa.Table, found: pa.Table) -> pa.Table:
        sources = sources.sort_by("source")
        names = sources.column("source").to_pylist()
        zero, left, right = (sources.column(c).to_numpy() for c in ("zero", "left", "right"))
        terms = found.column("term").combine_chunks().dictionary_encode() if len(found) else None
        seen = len(terms.dictionary) if len(found) else 0
        p = np.repeat(zero[:, None], seen, axis=1)
        if seen:
            row = {s: i for i, s in enumerate(names)}
            p[[row[s] for s in found.column("source").to_pylist()], terms.indices.to_numpy()] = found.column("p").to_numpy()
        a, b, value = [], [], []
        for i in np.flatnonzero(left):
            others = np.flatnonzero(right)
            others = others[others > i] if key[1].as_py() == key[2].as_py() else others
            a += [i] * len(others)
            b += others.tolist()
            value += np.abs(p[others] - p[i]).sum(axis=1).tolist()
        first, second = ([names[min(x, y)] for x, y in zip(a, b, strict=True)], [names[max(x, y)] for x, y in zip(a, b, strict=True)])
        apart = np.abs(zero[a] - zero[b]) if a else np.zeros(0, np.int64)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pa.array(first, pa.string()), "b": pa.array(second, pa.string()), "value": pa.array(value, pa.int64()), "seen": pa.array([seen] * len(a), pa.int64()), "apart": pa.array(apart, pa.int64())})

    keys = ("lang", "i", "j", "shard")
    sums = member.groupBy(*keys).cogroup(posting.groupBy(*keys)).applyInArrow(run, "lang string, a string, b string, value bigint, seen bigint, apart bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("apart").alias("apart"))
    sums = sums.join(groups.groupBy("lang").agg(F.max("v").alias("v")), "lang")
    return sums.select("lang", "a", "b", F.when(F.col("v") == 0, 0).otherwise(F.col("value") + (F.col("v") - F.col("seen")) * F.col("apart")).alias("value"))


def audit(docs: DataFrame, *, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows compare a source with each other one of its language, `term` rows
    are the first `top` terms that a source uses more than its language does."""
    vocabulary = written(document_frequencies(docs).filter(F.col("n_docs") >= least_docs).select("lang", "term"), "vocabulary")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    largest = sizes.agg(F.max("v").alias("v")).first()["v"] or 0  # one number
    counts = written(recount(docs, vocabulary, max(1, -(-largest // BLOCK))), "postings")

    every = _texts(docs).select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "v"])
    groups = written(groups.withColumn("zero", F.when(F.col("v") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))).otherwise(0)), "groups")

    shares = counts.join(groups.select("lang", "source", "total", "v"), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))
    pairs = _pairs(groups, shares.select("lang", "source", "term", "p"))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    usual = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(lang_totals, "lang").select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    more = shares.join(usual, ["lang", "term"]).filter("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    w = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), F.row_number().over(w).alias("rank"))
    return ranked(both, "pair").unionByName(ranked(more, "term").filter(F.col("rank") <= top))

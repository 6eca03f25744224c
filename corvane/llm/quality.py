"""Quality rules: counts of whole texts, and an isolation forest over their shares.

Each document's rule statistics become shares that don't depend on its length. Trees of random
splits are grown on 256 rows each, as the method has it, drawn from all labelled rows; junk is
isolated by short paths. The threshold on the path score is calibrated on all labelled rows, by
exact counts of their scores in BINS steps. The forest is a few thousand numbers and travels with
the task.

Null and empty texts have no words and fail the base rule. Texts of any length count as a whole.
Without labels of both kinds there is nothing to calibrate and the forest rejects nobody. Repeated
rows are judged alike; an empty table gives no rows; extra columns are ignored or passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bernoulli, map_arrow, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Share that a rule allows; features are the square roots of what exceeds it, so that ordinary texts lie together.
ALLOWED = {"symbols": 0.01, "dup_lines": 0.35, "repeated": 0.3, "stutter": 0.05, "upper": 0.15, "exclaimed": 0.01}
FEATURES = tuple(ALLOWED)
#: Steps of the score in which labelled rows are counted, and trees of the forest with the rows of each.
BINS = 1 << 16
TREES, TREE_ROWS = 100, 256

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True


def _per_document(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeats(keys: np.ndarray, same) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether it occurs more than once, and whether an equal one came earlier.

    Equal items have equal keys; same(i, j) tells whether items with equal keys are equal."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    again = np.zeros(len(s), bool)
    again[1:] = s[1:] == s[:-1]
    at = np.flatnonzero(again)
    wrong = at[~same(order[at - 1], order[at])]
    if len(wrong):  # different items of one key: they get keys of their own
        keys = keys.copy()
        for key in np.unique(s[wrong]).tolist():
            heads: list[int] = []
            for x in np.flatnonzero(keys == np.uint64(key)).tolist():
                n = next((k for k, h in enumerate(heads) if same(np.array([h]), np.array([x]))[0]), len(heads))
                heads += [x] * (n == len(heads))
                keys[x] = K.mix64(np.array([key + n], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
        return _repeats(keys, same)
    many = again.copy()
    many[:-1] |= again[1:]
    out, later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    out[order], later[order] = many, again
    return out, later


def _same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """same(i, j) for spans of data."""
    length = ends - starts

    def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = length[i] == length[j]
        k = np.flatnonzero(out)
        out[k] = K.same_bytes(data, starts[i[k]], data, starts[j[k]], length[i[k]])
        return out

    return same


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (as COUNTS) and features (as FEATURES), a row per document."""
    n = len(off) - 1
    starts, ends, n_words = K.words(data, off)
    space = K.SPACE[data]
    lead = ((data & 0xC0) != 0x80) & ~space
    word_chars = _per_document(lead, off)
    n_symbols = _per_document(_IS_SYMBOL[data], off)
    doc = np.repeat(np.arange(n), n_words)
    salt = K.mix64(np.arange(1, n + 1).astype(np.uint64))

    hashes = K.span_hash(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.cumsum(n_words) - n_words
    stutter = np.zeros(len(doc), bool)
    if len(doc) > 1:
        stutter[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])  # a feature only, so hashes do
    n_repeat = np.zeros(n, np.int64)
    if len(doc) >= WINDOW:
        m = len(doc) - WINDOW + 1
        whole = doc[:m] == doc[WINDOW - 1 :]
        keys = salt[doc[:m]].copy()
        for k in range(WINDOW):
            keys = K.mix64(keys * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m])
        at = np.flatnonzero(whole)
        word = _same_spans(data, starts, ends)

        def window(i, j):
            if not len(i):
                return np.zeros(0, bool)
            k = np.arange(WINDOW)
            return word((at[i][:, None] + k).ravel(), (at[j][:, None] + k).ravel()).reshape(-1, WINDOW).all(axis=1) & (doc[at[i]] == doc[at[j]])

        many, _ = _repeats(keys[at], window)
        at = at[many]
        cover = np.zeros(len(doc) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        n_repeat = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)

    # lines with a word, equal to an earlier one of the document
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([off[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(off, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), off[line_doc + 1])
    closed = (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else np.zeros(0, bool)
    line_end = line_end - closed
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=solid[1:])
    full = np.flatnonzero(solid[line_end] > solid[line_start])
    keys = K.span_hash(data, line_start[full], line_end[full]) if len(full) else np.zeros(0, np.uint64)
    line, own = _same_spans(data, line_start[full], line_end[full]), line_doc[full]
    _, later = _repeats(K.mix64(keys ^ salt[own]), lambda i, j: line(i, j) & (own[i] == own[j]))
    n_dup = np.bincount(line_doc[full][later], minlength=n)
    n_lines = np.bincount(line_doc[full], minlength=n)

    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1).astype(np.int64)
    chars, word_n = np.maximum(word_chars, 1), np.maximum(n_words, 1)
    shares = {
        "symbols": n_symbols / chars,
        "dup_lines": n_dup / np.maximum(n_lines, 1),
        "repeated": n_repeat / word_n,
        "stutter": np.bincount(doc[stutter], minlength=n) / word_n,
        "upper": _per_document(_IS_UPPER[data], off) / chars,
        "exclaimed": _per_document(data == 33, off) / chars,
    }
    features = np.stack([np.sqrt(np.maximum(shares[f] - ALLOWED[f], 0)) for f in FEATURES], axis=1)
    return counts, features


def base_failed(counts: np.ndarray, min_words: int = 20, repeat_percent: int = 30) -> np.ndarray:
    return (counts[:, 0] < min_words) | (100 * counts[:, 4] > repeat_percent * counts[:, 0])


class IsolationForest:
    """Random-split trees in flat arrays; score near 1: short paths, an anomaly."""

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(sample, len(x)))))))
        self.norm = _mean_path(min(sample, len(x)))
        size = (2 << self.depth) - 1
        self.feature = np.full((trees, size), -1, np.int64)
        self.cut = np.zeros((trees, size))
        self.extra = np.zeros((trees, size))
        for t in range(trees):
            rows = x[rng.choice(len(x), min(sample, len(x)), replace=False)]
            todo = [(0, rows, 0)]
            while todo:
                node, part, depth = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                usable = np.flatnonzero(high > low)
                if depth == self.depth or len(part) < 2 or not len(usable):
                    self.extra[t, node] = depth + _mean_path(len(part))
                    continue
                f = int(rng.choice(usable))
                cut = rng.uniform(low[f], high[f])
                self.feature[t, node], self.cut[t, node] = f, cut
                left = part[:, f] <= cut
                todo += [(2 * node + 1, part[left], depth + 1), (2 * node + 2, part[~left], depth + 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > self.cut[t, node]), node)
            total += self.extra[t, node]
        return 2.0 ** (-total / len(self.feature) / max(self.norm, 1e-9))


def _mean_path(n: int) -> float:
    """The mean path of an unsuccessful search in a tree of n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def calibrate(scores: np.ndarray, good: np.ndarray, good_weight: float, counts: np.ndarray | None = None, width: float = 0.0) -> float:
    """The threshold with the least sum of the missed share of junk and good_weight times the lost share of good rows.

    counts: of rows at each score (by default one); width: how far above it they may lie."""
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    if not good.any() or good.all() or not len(scores):
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, g, n = scores[order], good[order], counts[order]
    lost, caught = np.cumsum(n * g) / (n * g).sum(), np.cumsum(n * ~g) / (n * ~g).sum()
    cost = np.concatenate([[1.0], 1 - caught + good_weight * lost])
    ends = np.concatenate([[True], np.append(s[1:] < s[:-1], True)])
    best = int(np.flatnonzero(ends)[np.argmin(cost[ends])])
    if best == 0:
        return float("inf")
    return float((s[best - 1] + s[best] + width) / 2) if best < len(s) else float(s[-1] - 1e-9)


class Model:
    def __init__(self, forest: IsolationForest | None, threshold: float, counted: int = 0):
        """counted: the labelled rows that the threshold rests on."""
        self.forest, self.threshold, self.counted = forest, threshold, counted

    def judge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts, base_failed, anomaly score, kept."""
        counts, features = statistics(data, off)
        failed = base_failed(counts)
        score = self.forest.score(features) if self.forest is not None else np.zeros(len(counts))
        return counts, failed, score, ~failed & (score < self.threshold)


def fit(docs: DataFrame, labels: DataFrame, *, junk_share: float = 0.05, good_weight: float = 8.0, seed: int = 7) -> Model:
    """Forest and threshold from all labelled rows that pass the base rule; the trees see junk_share of junk.

    Texts are read once and don't move: their features meet the labels. The driver gets the rows that trees are grown on, about
    TREES * TREE_ROWS at any size, and the counts of scores, at most two for each of BINS steps."""
    names = [f"f{k}" for k in range(len(FEATURES))]

    def measure(batch):
        for part in K.slices(batch):
            counts, features = statistics(*K.utf8(part.column(1))[:2])
            yield {"doc_id": part.column(0), "failed": base_failed(counts)} | {c: features[:, k] for k, c in enumerate(names)}

    texts = docs.select("doc_id", "text").filter("text is not null and doc_id is not null")
    measured = map_arrow(texts, measure, "doc_id bigint, failed boolean, " + ", ".join(f"{c} double" for c in names)).filter("not failed")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = written(measured.join(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id").drop("failed"), "labelled")
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_good, n_bad = totals.get(1, 0), totals.get(0, 0)
    if n_good < 2 or not n_bad:
        return Model(None, float("inf"))
    most = TREES * TREE_ROWS
    junk = max(1, int(junk_share * min(n_good, most)))
    share = {1: min(1.0, most / n_good), 0: min(1.0, (2 * junk + 1000) / n_bad)}
    drawn = rows.filter(F.when(F.col("label") == 1, bernoulli(F.col("doc_id"), share[1], "quality")).otherwise(bernoulli(F.col("doc_id"), share[0], "quality")))
    table = drawn.select("label", *names).toPandas().sort_values(["label", *names])  # any order of arrival gives one model
    good, x = table["label"].to_numpy() > 0, table[names].to_numpy(float)
    rng = np.random.default_rng(seed)
    bad = np.flatnonzero(~good)
    bad = rng.choice(bad, min(len(bad), junk), replace=False)
    forest = IsolationForest(x[np.concatenate([np.flatnonzero(good), bad])], TREES, TREE_ROWS, seed)

    def score(batch):
        step = np.floor(forest.score(np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)) * BINS)
        yield {"label": batch.column(0), "step": step.astype(np.int32)}

    counts = map_arrow(rows.select("label", *names), score, "label int, step int").groupBy("label", "step").agg(F.count("*").alias("n")).toPandas()
    n = counts["n"].to_numpy()
    return Model(forest, calibrate(counts["step"].to_numpy() / BINS, counts["label"].to_numpy() > 0, good_weight, n, 1 / BINS), int(n.sum()))


def judge_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the forest's score."""

    def run(batch):
        for part in K.slices(batch):
            data, off, _ = K.utf8(part.column(1))
            counts, failed, score, kept = model.judge(data, off)
            yield {"doc_id": part.column(0)} | {c: counts[:, k] for k, c in enumerate(COUNTS)} | {"base_failed": failed, "kept": kept, "anomaly": score}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")


def keep_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all their columns, that are kept."""
    at = docs.columns.index("text")

    def run(batch):
        for part in K.slices(batch):
            data, off, _ = K.utf8(part.column(at))
            yield part.filter(pa.array(model.judge(data, off)[3]))

    return map_arrow(docs, run, docs.schema)

"""Toxicity by a linear-chain conditional random field.

Document labels become token labels first: whole words and word beginnings that mark toxic
documents are selected greedily, each time the one that explains most toxic documents that are
still unexplained, so that what merely keeps company with a toxic word (or is copied with it) is
left out. In toxic documents tokens with such a feature are labelled toxic. A two-tag chain over these
features is trained on segments; forward-backward marginals over whole texts give offending spans
and two document statistics, which a logistic curve turns into the score.

All of it is learnt from a bounded sample of labelled rows (`toxic_rows`, `clean_rows`); the model
is a few hundred numbers. Null and empty texts score as texts without a toxic token. Texts of any
length are scored whole. With no toxic or no clean labelled rows every score is the toxic share (0
without labels). Repeated rows score alike; extra columns are ignored or passed through.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import BLANK, OTHER, char_classes
from .common import end_task, labelled_sample, map_arrow, remainder

PREFIXES = (3, 4, 5, 6, 7, 8)
SEGMENT = 48
LIMIT = 30.0


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Word characters (letters and digits), and simple lower case."""
    kind = char_classes()
    word = (kind != BLANK) & (kind != OTHER)
    low = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(word).tolist():
        s = chr(c).lower()
        if len(s) == 1:
            low[c] = ord(s)
    return word, low


def tokens(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (code points) of runs of letters and digits, tokens per document, lower-case code points."""
    word, lower = _tables()
    n = len(codes)
    inner = word[codes]
    begin = inner.copy()
    begin[1:] &= ~inner[:-1]
    cut = off[:-1][off[:-1] < n]
    begin[cut] = inner[cut]
    end = inner.copy()
    end[:-1] &= ~inner[1:]
    last = off[1:][off[1:] > 0] - 1
    end[last] = inner[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.diff(np.searchsorted(starts, off)), lower[codes]


def token_features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds=(0, *PREFIXES)) -> dict[int, np.ndarray]:
    """Hash of the word (0) and of each prefix that is shorter than the word; 0 where there is none."""
    out = {}
    for k in kinds:
        if k == 0:
            out[0] = K.span_hash(low, starts, ends) | np.uint64(1)
        else:
            long = np.flatnonzero(ends - starts > k)
            h = np.zeros(len(starts), np.uint64)
            h[long] = K.mix64(K.span_hash(low, starts[long], starts[long] + k) + np.uint64(k)) | np.uint64(1)
            out[k] = h
    return out


def _unique_pairs(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    u = np.unique(a.astype(np.int64) * n_b + b)
    return u // n_b, u % n_b


def distinct_documents(hashes: np.ndarray, count: np.ndarray, bands: int = 8, gram: int = 5) -> np.ndarray:
    """True for one document of each group of near copies (those that share a min-hash of word 5-grams)."""
    n, first = len(count), np.cumsum(count) - count
    doc = np.repeat(np.arange(n), count)
    if not len(doc):
        return np.ones(n, bool)
    key, last = np.zeros(len(doc), np.uint64), np.minimum(first + count - 1, len(doc) - 1)[doc]
    for k in range(gram):
        key = K.mix64(key * np.uint64(31) + hashes[np.minimum(np.arange(len(doc)) + k, last)])
    some = np.flatnonzero(count > 0)
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for band in range(bands):
        low = np.minimum.reduceat(K.mix64(key ^ K.mix64(np.array([band + 1], np.uint64))[0]), first[some])
        order = np.argsort(low, kind="stable")
        for i in np.flatnonzero(low[order][1:] == low[order][:-1]).tolist():
            x, y = find(int(some[order[i]])), find(int(some[order[i + 1]]))
            parent[max(x, y)] = min(x, y)
    return np.array([find(k) == k for k in range(n)])


class Words:
    """The distinct words of texts with their features, and each text's words in order as numbers; built slice by slice."""

    def __init__(self, column) -> None:
        index, docs, table = K.HashIndex(16), [], {k: [] for k in (0, *PREFIXES)}
        self.count = np.zeros(len(column), np.int64)
        at = 0
        batch = pa.RecordBatch.from_arrays([column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column], names=["text"])
        for part in K.slices(batch):
            data, off, _ = K.utf8(part.column(0))
            starts, ends, count, low = tokens(K.codepoints(data), K.char_offsets(data, off))
            keys = K.span_hash(low, starts, ends)
            got = index.find(keys)
            new = np.flatnonzero(got < 0)
            if len(new):
                distinct, first = np.unique(keys[new], return_index=True)
                first = new[first]
                index.add(distinct)
                for k, h in token_features(low, starts[first], ends[first]).items():
                    table[k].append(h)
                got[new] = index.find(keys[new])
            docs.append(got.astype(np.int32))
            self.count[at : at + len(count)] = count
            at += len(count)
        none = [np.zeros(0, np.uint64)]
        self.table = {k: np.concatenate(v or none) for k, v in table.items()}
        self.word = np.concatenate(docs or [np.zeros(0, np.int32)])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, word)."""
        key = np.repeat(np.arange(len(self.count)) * (len(self.table[0]) + 1), self.count)
        key += self.word
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        return (key // (len(self.table[0]) + 1)).astype(np.int32), (key % (len(self.table[0]) + 1)).astype(np.int32)


def select_features(words: Words, toxic: np.ndarray, counted: np.ndarray, clean_weight: float, *, most: int = 400, precision: float = 0.8, evidence: float = 18.0) -> list[tuple[int, int]]:
    """(kind, hash) of the features that mark toxic documents, the most telling first.

    counted: toxic documents that count (one of each group of near copies). A feature must have the
    precision, and `evidence` nats for its documents being toxic so often by chance. Each choice
    takes the words that it covers out of the count.
    """
    kinds = list(words.table)
    doc, word = words.pairs()
    mine, others = np.flatnonzero((toxic & counted)[doc]), np.flatnonzero(~toxic[doc])
    share = (toxic & counted).sum() / max(1, (toxic & counted).sum() + (~toxic).sum())

    def telling(n: np.ndarray, clean: np.ndarray) -> np.ndarray:
        total = np.maximum(n + clean, 1)
        p = n / total
        nats = n * np.log(np.maximum(p, 1e-12) / share) + clean * np.log(np.maximum(1 - p, 1e-12) / (1 - share))
        return (n >= 4) & (p > share) & (nats >= evidence) & (n >= precision * (n + clean_weight * clean))

    # Kind by kind, so that only what may be chosen is held for all kinds at once.
    found = []
    for k in kinds:
        flat = words.table[k][word[mine]]
        ok = flat != 0
        names, index = np.unique(flat[ok], return_inverse=True)
        if not len(names):
            continue
        owner = mine[ok]
        support = np.bincount(_unique_pairs(doc[owner], index, len(names))[1], minlength=len(names))
        lookup = K.HashIndex(max(10, int(2 * len(names)).bit_length()))
        lookup.add(names)
        got = lookup.find(words.table[k])[word[others]]
        hit = np.flatnonzero(got >= 0)
        clean = np.bincount(_unique_pairs(doc[others[hit]], got[hit], len(names))[1], minlength=len(names))
        good = telling(support, clean)
        number = np.cumsum(good) - 1
        keep = good[index]
        found.append((k, names[good], clean[good], owner[keep], number[index[keep]]))
        del flat, ok, names, index, owner, lookup, got, hit, keep
        end_task()
    if not found:
        return []
    base = np.cumsum([0] + [len(f[1]) for f in found])
    names, clean = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
    kind_of = np.repeat([f[0] for f in found], np.diff(base))
    owner, index = np.concatenate([f[3] for f in found]), np.concatenate([f[4] + at for f, at in zip(found, base, strict=False)])
    width = np.where(kind_of == 0, 99, kind_of)
    n_names = len(names)
    chosen: list[tuple[int, int]] = []
    while len(chosen) < most and len(index):
        left = np.bincount(_unique_pairs(doc[owner], index, n_names)[1], minlength=n_names)
        usable = np.flatnonzero(telling(left, clean))
        if not len(usable):
            break
        # Longer features first among equals: a whole word says more than its beginning.
        best = usable[np.lexsort((names[usable], -width[usable], -(left - 3 * clean)[usable]))[0]]
        chosen.append((int(kind_of[best]), int(names[best])))
        keep = ~np.isin(owner, owner[index == best])
        owner, index = owner[keep], index[keep]
    return chosen


class Chain:
    """Two tags; tag 1 is toxic. Potentials of tag 1 and of the moves 0-1, 1-0, 1-1 against those of tag 0 and 0-0."""

    def __init__(self, bias: float, weights: np.ndarray, moves: np.ndarray):
        self.bias, self.weights, self.moves = bias, weights, moves

    def logits(self, e: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log odds of the toxic tag at each token of sequences that lie one after another."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        start, size = off[:-1][order], size[order]
        a01, a10, a11 = np.exp(self.moves)
        forward, backward = np.zeros(len(e)), np.zeros(len(e))
        active = (len(size) - np.searchsorted(size[::-1], np.arange(int(size.max(initial=0))), "right")).tolist()
        r = np.zeros(len(size))
        for t, n in enumerate(active):
            at = start[:n] + t
            if t == 0:
                r[:n] = e[at]
            else:
                x = np.exp(np.clip(r[:n], -LIMIT, LIMIT))
                r[:n] = e[at] + np.log((a01 + a11 * x) / (1 + a10 * x))
            forward[at] = r[:n]
        s = np.zeros(len(size))
        for t in range(len(active) - 2, -1, -1):
            n = active[t + 1]
            at = start[:n] + t
            x = np.exp(np.clip(e[at + 1] + s[:n], -LIMIT, LIMIT))
            s[:n] = np.log((a10 + a11 * x) / (1 + a01 * x))
            backward[at] = s[:n]
        return forward + backward


def train_chain(feature: np.ndarray, y: np.ndarray, n_features: int, weight: np.ndarray | None = None, *, steps: int = 120, rate: float = 0.25, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood on segments; feature: segments x SEGMENT x slots of feature numbers (0: none), y: tags, -1 beyond the end;
    weight: how often each segment counts."""
    n, width, slots = feature.shape
    weight = np.ones(n) if weight is None else weight.astype(float)
    each = weight[:, None]
    real = y >= 0
    w, bias, moves = np.zeros(n_features + 1), -3.0, np.array([-1.0, 0.0, 0.0])
    y1 = (y == 1).astype(float)
    pair = real[:, 1:]
    seen = np.array([(((y[:, :-1] == p) & (y[:, 1:] == q)) * each).sum() for p, q in ((0, 1), (1, 0), (1, 1))])
    m1 = np.zeros(n_features + 1 + 4)
    m2 = np.zeros_like(m1)
    for step in range(1, steps + 1):
        e = bias + w[feature].sum(axis=2)
        a01, a10, a11 = np.exp(moves)
        ex = np.exp(np.clip(e, -LIMIT, LIMIT)) * real + ~real
        f0, f1 = np.zeros((width, n)), np.zeros((width, n))
        f0[0], f1[0] = 1 / (1 + ex[:, 0]), ex[:, 0] / (1 + ex[:, 0])
        for t in range(1, width):
            p0, p1 = f0[t - 1] + f1[t - 1] * a10, (f0[t - 1] * a01 + f1[t - 1] * a11) * ex[:, t]
            z = p0 + p1
            f0[t], f1[t] = np.where(real[:, t], p0 / z, f0[t - 1]), np.where(real[:, t], p1 / z, f1[t - 1])
        b0, b1 = np.ones(n), np.ones(n)
        p = np.zeros((n, width))
        expected = np.zeros(3)
        for t in range(width - 1, -1, -1):
            g1 = f1[t] * b1
            p[:, t] = np.where(real[:, t], g1 / (f0[t] * b0 + g1), 0)
            if t:
                q = np.stack([f0[t - 1] * b0, f0[t - 1] * a01 * ex[:, t] * b1, f1[t - 1] * a10 * b0, f1[t - 1] * a11 * ex[:, t] * b1])
                q = q / q.sum(axis=0) * pair[:, t - 1]
                expected += q[1:] @ weight
                n0, n1 = b0 + a01 * ex[:, t] * b1, a10 * b0 + a11 * ex[:, t] * b1
                z = n0 + n1
                b0, b1 = np.where(real[:, t], n0 / z, b0), np.where(real[:, t], n1 / z, b1)
        d = np.where(real, y1 - p, 0) * each
        grad_w = np.bincount(feature.ravel(), np.repeat(d.ravel(), slots), minlength=n_features + 1)
        grad_w[0] = 0
        grad = np.concatenate([grad_w, [d.sum()], seen - expected]) / weight.sum() - ridge * np.concatenate([w, [bias], moves])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, bias, moves = w + move[:-4], bias + move[-4], moves + move[-3:]
        w[0] = 0
    return Chain(float(bias), w, moves)


class Model:
    """Features, chain and the document's logistic curve."""

    def __init__(self, features: list[tuple[int, int]], chain: Chain | None, curve: np.ndarray, share: float):
        self.features, self.chain, self.curve, self.share = features, chain, curve, share
        self.kinds = sorted({k for k, _ in features})
        self.by_kind = {k: (np.array(sorted(h for q, h in features if q == k), np.uint64)) for k in self.kinds}
        number = {f: i + 1 for i, f in enumerate(features)}
        self.number = {k: np.array([number[(k, int(h))] for h in v]) for k, v in self.by_kind.items()}
        self.sieve = {}
        for k, v in self.by_kind.items():
            self.sieve[k] = np.zeros(1 << 16, bool)
            self.sieve[k][(v >> np.uint64(48)).astype(np.int64)] = True

    def slots(self, features: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature number) of all tokens that have a feature, from the hashes of each kind."""
        at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in self.kinds:
            h = features[k]
            maybe = np.flatnonzero(self.sieve[k][(h >> np.uint64(48)).astype(np.int64)])
            pos = np.minimum(np.searchsorted(self.by_kind[k], h[maybe]), len(self.by_kind[k]) - 1)
            hit = self.by_kind[k][pos] == h[maybe]
            at.append(maybe[hit])
            which.append(self.number[k][pos[hit]])
        return np.concatenate(at), np.concatenate(which)

    def statistics(self, codes: np.ndarray, off: np.ndarray):
        """Per document the largest log odds and the log of 1 + the expected toxic tokens; then the offending tokens."""
        n = len(off) - 1
        starts, ends, count, low = tokens(codes, off)
        z1, z2 = np.full(n, -LIMIT), np.zeros(n)
        none = np.zeros(0, np.int64)
        if self.chain is None or not len(starts):
            return z1, z2, (none, none, none, np.zeros(0))
        first = np.concatenate([[0], np.cumsum(count)])
        token, which = self.slots(token_features(low, starts, ends, self.kinds))
        doc_of = np.searchsorted(first, token, "right") - 1
        flagged = np.zeros(n, bool)
        flagged[doc_of] = True
        plain = self._plain()
        z1 = np.where(count > 0, plain[np.minimum(count, len(plain) - 1)], -LIMIT)
        docs = np.flatnonzero(flagged)
        if not len(docs):
            return z1, z2, (none, none, none, np.zeros(0))
        at = np.concatenate([[0], np.cumsum(count[docs])])
        place = np.full(n, -1)
        place[docs] = np.arange(len(docs))
        e = np.full(at[-1], self.chain.bias)
        np.add.at(e, at[place[doc_of]] + token - first[doc_of], self.chain.weights[which])
        logit = self.chain.logits(e, at)
        p = 1 / (1 + np.exp(-np.clip(logit, -LIMIT, LIMIT)))
        z1[docs] = np.clip(np.maximum.reduceat(logit, at[:-1]), -LIMIT, LIMIT)
        z2[docs] = np.log1p(np.add.reduceat(np.where(p >= 0.05, p, 0), at[:-1]))
        bad = np.flatnonzero(p >= 0.5)
        which_doc = np.searchsorted(at, bad, "right") - 1
        tok = first[docs[which_doc]] + bad - at[which_doc]
        return z1, z2, (docs[which_doc], starts[tok], ends[tok], p[bad])

    def _plain(self) -> np.ndarray:
        """The largest log odds in texts of 0 to 64 tokens without a feature; beyond that it doesn't change."""
        if not hasattr(self, "_plain_logits"):
            lengths = np.arange(1, 65)
            off = np.concatenate([[0], np.cumsum(lengths)])
            logit = self.chain.logits(np.full(off[-1], self.chain.bias), off)
            self._plain_logits = np.clip(np.concatenate([[-LIMIT], np.maximum.reduceat(logit, off[:-1])]), -LIMIT, LIMIT)
        return self._plain_logits

    def score(self, z1: np.ndarray, z2: np.ndarray) -> np.ndarray:
        if self.chain is None:
            return np.full(len(z1), self.share)
        z = self.curve[0] + self.curve[1] * z1 + self.curve[2] * z2
        return 1 / (1 + np.exp(-np.clip(z, -LIMIT, LIMIT)))


def _fit_curve(z1: np.ndarray, z2: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method, slopes not below 0."""
    x = np.stack([np.ones(len(y)), z1, z2], axis=1)
    b = np.array([0.0, 0.3, 0.3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -LIMIT, LIMIT)))
        g = x.T @ (weight * (y - p)) - np.array([0, 1e-2, 1e-2]) * b
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2])
        b = b + np.clip(np.linalg.solve(h, g), -2, 2)
        b[1:] = np.maximum(b[1:], 0)
    return b


def fit(docs: DataFrame, labels: DataFrame, *, usable=None, toxic_rows: int = 2500, clean_rows: int = 4000) -> Model:
    """Learns from about toxic_rows toxic and clean_rows other labelled documents."""
    sample, totals = labelled_sample(docs, labels, "toxic", {1: toxic_rows, 0: clean_rows}, "toxicity", usable)
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    rows = sample.select("text", "label", F.xxhash64("doc_id", "text").alias("h")).toArrow()
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("h", "ascending"), ("label", "ascending")]))  # any order of arrival gives one model
    y = rows.column("label").to_numpy().astype(int)
    if not len(y) or y.all() or not y.any():
        return Model([], None, np.zeros(3), share)
    texts = rows.column("text").combine_chunks()
    del rows
    words = Words(texts)
    end_task()
    clean_weight = (totals[0] / max(1, (y == 0).sum())) / (totals[1] / max(1, (y == 1).sum()))
    some = np.flatnonzero(y == 1)
    distinct = np.zeros(len(y), bool)
    in_toxic = np.repeat(y == 1, words.count)
    distinct[some] = distinct_documents(words.table[0][words.word[in_toxic]], words.count[some])
    del in_toxic
    end_task()
    features = select_features(words, y == 1, distinct, clean_weight)
    end_task()
    if not features:
        return Model([], None, np.zeros(3), share)
    model = Model(features, None, np.zeros(3), share)
    word, which = model.slots(words.table)
    order = np.lexsort((which, word))
    word, which = word[order], which[order]
    nth = np.arange(len(word)) - np.searchsorted(word, word)
    of_word = np.zeros((len(words.table[0]), int(nth.max(initial=0)) + 1), np.int16)
    of_word[word, nth] = which
    marked = of_word[words.word, 0] > 0
    first = np.cumsum(words.count) - words.count
    doc = np.repeat(np.arange(len(y), dtype=np.int32), words.count)
    fresh = (np.arange(len(doc)) - first[doc]) % SEGMENT == 0
    seg_start = np.flatnonzero(fresh)
    seg_size = np.diff(np.append(seg_start, len(doc)))
    has = np.add.reduceat(marked, seg_start) > 0
    # Every segment counts; those without a feature differ by length only.
    plain, times = np.unique(seg_size[~has], return_counts=True)
    pick = np.flatnonzero(has)
    size = np.concatenate([seg_size[pick], plain])
    real = np.arange(SEGMENT) < size[:, None]
    rows_at = np.where(real[: len(pick)], seg_start[pick][:, None] + np.arange(SEGMENT), 0)
    tag, feature = np.where(real, 0, -1), np.zeros((*real.shape, of_word.shape[1]), np.int16)
    tag[: len(pick)] = np.where(real[: len(pick)], marked[rows_at] & (y[doc[rows_at]] == 1), -1)
    feature[: len(pick)] = of_word[words.word[rows_at]] * real[: len(pick), :, None]
    chain = train_chain(feature, tag, len(features), np.concatenate([np.ones(len(pick)), times]))
    model = Model(features, chain, np.zeros(3), share)
    del words, marked, doc, rows_at, tag, feature
    end_task()
    z = []
    for part in K.slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
        data, off, _ = K.utf8(part.column(0))
        z.append(np.stack(model.statistics(K.codepoints(data), K.char_offsets(data, off))[:2]))
    z1, z2 = np.concatenate(z, axis=1)
    model.curve = _fit_curve(z1, z2, y, np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum()))
    del texts
    end_task()
    return model


def is_held_out(doc_id: F.Column) -> F.Column:
    return remainder(doc_id, 3) == 1


def score_documents(docs: DataFrame, model: Model, *, threshold: float = 0.7, held_out=None) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans (code point offsets, probability)."""
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)) if held_out is not None else F.lit(False)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batch):
        for part in K.slices(batch, "text", K.SLICE_BYTES):
            data, off, _ = K.utf8(part.column(2))
            char_off = K.char_offsets(data, off)
            z1, z2, (doc, start, end, p) = model.statistics(K.codepoints(data), char_off)
            score = model.score(z1, z2)
            at = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array((start - char_off[doc]).astype(np.int32)), pa.array((end - char_off[doc]).astype(np.int32)), pa.array(p)], fields=list(span))
            yield {"doc_id": part.column(0), "held_out": part.column(1), "score": score, "predicted": (score >= threshold).astype(np.int32), "spans": pa.ListArray.from_arrays(pa.array(at), spans)}

    return map_arrow(docs.select("doc_id", held.alias("held"), "text"), run, "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def keep_documents(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """The documents, all their columns, whose score is below the threshold."""
    at = docs.columns.index("text")

    def run(batch):
        for part in K.slices(batch, "text", K.SLICE_BYTES):
            data, off, _ = K.utf8(part.column(at))
            z1, z2, _ = model.statistics(K.codepoints(data), K.char_offsets(data, off))
            yield part.filter(pa.array(model.score(z1, z2) < threshold))

    return map_arrow(docs, run, docs.schema)

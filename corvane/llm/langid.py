"""Language identification by cross-parsing.

Each language has a suffix automaton of a bounded sample of its labelled text. A text is parsed
greedily into the longest phrases that occur in a language's sample; each phrase counts the
logarithm of its sample's length (what naming a place in it costs), and the language with the least
sum wins. Blocks of BLOCK characters of all texts and all languages are parsed at once, one character
a step, over one transition table whose missing entries already begin the next phrase. A block
begins where a phrase is under way: its beginning is then parsed again from there, until both parses
are in one state. So the phrases are those of the whole text.

Null texts and texts without a letter are `und` with score 0. Without labelled text every text is
`und`. Of languages with equal sums the first by name wins, so ties are settled. Texts
count as a whole; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import LETTER, char_classes
from .common import bernoulli, kept_by, map_arrow, remainder

BLOCK = 4096
SPAN = 64  # characters of a text that lie together in a sample, at most
SYMBOLS = 62  # letters with a column of the table; the samples' other letters are looked up by state and letter
NONE, RARE = 63, 64  # symbol of letters that no sample has; first symbol of those without a column


@lru_cache(1)
def _lower() -> np.ndarray:
    """Lower-case code points of letters; 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(char_classes() == LETTER).tolist():
        s = chr(c).lower()
        out[c] = ord(s[0])
    return out


def normal(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one 0 for each run of other characters, and the new offsets."""
    if not len(codes):
        return np.zeros(0, np.uint32), off.copy()
    low = _lower()[codes]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
    starts = off[:-1][off[:-1] < len(low)]
    keep[starts] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], total[off]


def suffix_automaton(symbols: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions (state x symbol, -1: none) of all substrings of a sequence; state 0 is the start. Those of symbols
    from `width` on are listed: from state, symbol, to state."""
    link, length, nxt = [-1], [0], [{}]
    last = 0
    for c in symbols:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nxt.append({})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                nxt.append(nxt[q].copy())
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    out, more = np.full((len(length), width), -1, np.int32), []
    for s, d in enumerate(nxt):
        for c, t in d.items():
            if c < width:
                out[s, c] = t
            else:
                more.append((s, c, t))
    return out, np.array(more, np.int64).reshape(-1, 3).T


class Model:
    """Samples by language; the table is built where it is first used."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.samples = [samples[k] for k in self.languages]
        self.price = np.array([np.log2(max(2, len(x))) for x in self.samples])  # of a phrase
        self.key = hashlib.sha1("\0".join([*self.languages, *self.samples]).encode()).hexdigest()


_built: dict[str, tuple] = {}
kept_by("langid", _built.clear)


def _table(model: Model) -> tuple:
    """Flat transitions with the new-phrase flag in the lowest bit, start states, symbol of each code point; then for the
    letters without a column: keys (state x their number) with transitions, and each language's new phrase with each."""
    if model.key in _built:
        return _built[model.key]
    texts = []
    for s in model.samples:
        codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        texts.append(normal(codes, np.array([0, len(codes)]))[0])
    seen, n = np.unique(np.concatenate([t[t > 0] for t in texts] or [np.zeros(0, np.uint32)]), return_counts=True)
    letters = seen[np.argsort(-n, kind="stable")]
    width, n_rare = 64, max(0, len(letters) - SYMBOLS)
    symbol = np.full(0x110000, NONE, np.uint32 if n_rare else np.uint8)
    symbol[0] = 0
    symbol[letters[:SYMBOLS]] = np.arange(1, len(letters[:SYMBOLS]) + 1)
    symbol[letters[SYMBOLS:]] = np.arange(RARE, RARE + n_rare)
    parts, roots, base = [], [], 0
    keys, moves, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], []
    for t in texts:
        seq = symbol[t]
        move, (state, rare, to) = suffix_automaton(seq.tolist(), width)
        dead = len(move)  # after a symbol that the sample lacks, which is a phrase alone
        fresh = np.where(move[0] >= 0, move[0], dead).astype(np.int64)  # where a new phrase goes with each symbol
        step = np.empty((dead + 1, width), np.int64)
        step[:dead] = np.where(move >= 0, ((move.astype(np.int64) + base) * width) << 1, (((fresh + base) * width) << 1 | 1)[None, :])
        step[0] = ((fresh + base) * width) << 1  # a block's first phrase is counted at its beginning
        step[dead] = ((fresh + base) * width) << 1 | 1
        begin = np.full(n_rare, (dead + base) * width << 1 | 1, np.uint32)
        begin[rare[state == 0] - RARE] = (to[state == 0] + base) * width << 1 | 1
        begins.append(begin)
        keys.append((state + base) * n_rare + rare - RARE)
        moves.append(((to + base) * width << 1).astype(np.uint32))
        parts.append(step.astype(np.uint32))
        roots.append(base * width)
        base += dead + 1
    _built.clear()
    keys, moves = np.concatenate(keys), np.concatenate(moves)
    order = np.argsort(keys)
    _built[model.key] = (np.concatenate(parts).ravel(), np.array(roots, np.uint32), symbol, keys[order], moves[order], np.array(begins, np.uint32))
    return _built[model.key]


def phrases(model: Model, codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per document and language, and the number of letters of each document."""
    table, roots, symbol, keys, moves, begins = _table(model)
    low, at = normal(codes, off)
    letters = np.concatenate([[0], np.cumsum(low > 0)])
    n_letters = letters[at[1:]] - letters[at[:-1]]
    sym = symbol[low]
    size = np.diff(at)
    n_blocks = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(size)), n_blocks)
    nth = K.ranges(np.zeros(len(size), np.int64), n_blocks)
    start = at[:-1][doc] + nth * BLOCK
    length = np.minimum(size[doc] - nth * BLOCK, BLOCK)
    order = np.argsort(-length, kind="stable")
    langs, one = len(roots), np.uint32(1)

    def step(state: np.ndarray, now: np.ndarray) -> np.ndarray:
        """The next states, and in the lowest bit whether a phrase begins there."""
        e = table[state + (np.minimum(now, NONE) if len(keys) else now)]
        if len(keys) and len(cols := np.flatnonzero(now >= RARE)):
            rare = (now[cols] - RARE).astype(np.int64)
            here = state[:, cols]
            key = (here >> np.uint32(6)).astype(np.int64) * begins.shape[1] + rare
            pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            new = np.where(here == roots[:, None], begins[:, rare] & ~one, begins[:, rare])
            e[:, cols] = np.where(keys[pos] == key, moves[pos], new)
        return e

    count = np.zeros((langs, len(doc)), np.int64)
    state = np.repeat(roots[:, None], len(doc), axis=1)
    active = len(doc) - np.searchsorted(length[order][::-1], np.arange(int(length.max(initial=0))), "right")
    begin = start[order]
    for t, n in enumerate(active.tolist()):
        e = step(state[:, :n], sym[begin[:n] + t])
        count[:, :n] += e & one
        state[:, :n] = e >> one
    count[:, order], state[:, order] = count.copy(), state.copy()
    count[:, nth == 0] += 1  # the phrase that a text begins with
    # Later blocks: from the state that the block before ends in, beside the parse from the start, until they agree.
    entered = np.repeat(roots[:, None], len(doc), axis=1)
    todo = np.flatnonzero(nth > 0)
    while len(todo):
        now, was = state[:, todo - 1].copy(), entered[:, todo].copy()
        entered[:, todo] = now
        live, t = np.arange(len(todo)), 0
        moved = []
        while len(live):
            s = sym[start[todo[live]] + t]
            a, b = step(was[:, live], s), step(now[:, live], s)
            count[:, todo[live]] += (b & one).astype(np.int64) - (a & one)
            was[:, live], now[:, live] = a >> one, b >> one
            t += 1
            apart = (a >> one != b >> one).any(axis=0)
            ended = t == length[todo[live]]
            moved.append(todo[live[apart & ended]])
            live = live[apart & ~ended]
        moved = np.concatenate(moved)  # their last state changes, so the next block's beginning does
        state[:, moved] = now[:, np.searchsorted(todo, moved)]
        nxt = moved + 1
        nxt = nxt[nxt < len(doc)]
        todo = np.sort(nxt[nth[nxt] > 0])
    out = np.zeros((len(size), langs), np.int64)
    for k in range(langs):
        out[:, k] = np.bincount(doc, count[k], minlength=len(size))
    return out, n_letters


def _spans(text: str, seed: int, size: int, most: int) -> tuple[list[int], list[str]]:
    """Begins and texts of spans of `size` characters from all over a text, in an order by hash, about `most` characters in all."""
    n = -(-len(text) // size)
    order = np.random.default_rng(seed & (1 << 63) - 1).permutation(n)[: -(-most // size)]
    return (order * size).tolist(), [text[k * size : (k + 1) * size] for k in order.tolist()]


def _sample(texts: list[tuple[list[int], list[str]]], budget: int) -> str:
    """One span of each text in turn until the budget is full, each text's in their order; neighbours join."""
    room, taken, nth = budget, [[] for _ in texts], 0
    while room > 0 and any(nth < len(at) for at, _ in texts):
        for (at, parts), mine in zip(texts, taken, strict=True):
            if nth < len(at) and room > 0:
                part = parts[nth][:room]
                mine.append((at[nth], part))
                room -= len(part)
        nth += 1
    out, end = [], -1
    for mine in taken:
        for at, part in sorted(mine):
            out += [part] if at == end else ["\n", part]
            end = at + len(part)
        end = -1
    return "".join(out[1:]) or "\n"


def fit(docs: DataFrame, *, usable=None, docs_per_language: int = 300, chars_per_language: int = 40_000) -> Model:
    """Learns from text and lang of usable rows: about docs_per_language texts of each language, chosen by a hash
    of the id. Spans from places all over each text, one of every text in turn, make the language's sample of
    chars_per_language characters."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if usable is not None:
        known = known.filter(usable(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & bernoulli(F.col("doc_id"), min(1.0, docs_per_language / n), "langid"))
    # Twice as many texts as asked for would still give a span each.
    size = max(1, min(SPAN, chars_per_language // (2 * docs_per_language)))

    def spans(batch):
        langs, seeds = batch.column(0), batch.column(2).to_pylist()
        for k, seed in enumerate(seeds):
            at, parts = _spans(batch.column(1)[k].as_py(), seed, size, chars_per_language)
            yield {"lang": langs.slice(k, 1), "h": [seed], "at": [at], "parts": [parts]}

    rows = map_arrow(known.filter(chosen).select("lang", "text", F.xxhash64("doc_id", "text")), spans, "lang string, h bigint, at array<bigint>, parts array<string>").collect()
    samples = {}
    for lang in sizes:
        own = sorted(((r["h"], r["at"], r["parts"]) for r in rows if r["lang"] == lang), key=lambda r: (r[0], r[2]))
        samples[lang] = _sample([(at, parts) for _, at, parts in own], chars_per_language)
    return Model(samples)


def identify_documents(docs: DataFrame, model: Model, *, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_letters and the phrases that the winner needed."""
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)) if held_out is not None else F.lit(False)

    def run(batch):
        for part in K.slices(batch, "text"):
            data, off, _ = K.utf8(part.column(2))
            codes = K.codepoints(data)
            n = part.num_rows
            if not model.languages:
                yield {"doc_id": part.column(0), "held_out": part.column(1), "lang_pred": ["und"] * n, "score": np.zeros(n), "n_letters": np.zeros(n, np.int64), "n_phrases": np.zeros(n, np.int64)}
                continue
            count, letters = phrases(model, codes, K.char_offsets(data, off))
            cost = count * model.price
            best = cost.argmin(axis=1)
            least = cost[np.arange(n), best]
            rest = cost.copy()
            rest[np.arange(n), best] = np.inf
            second = rest.min(axis=1) if count.shape[1] > 1 else least * 3
            score = np.where(letters > 0, second / np.maximum(second + least, 1e-9), 0.0)
            yield {
                "doc_id": part.column(0),
                "held_out": part.column(1),
                "lang_pred": [model.languages[b] if k else "und" for b, k in zip(best.tolist(), (letters > 0).tolist(), strict=True)],
                "score": score,
                "n_letters": letters,
                "n_phrases": count[np.arange(n), best],
            }

    return map_arrow(docs.select("doc_id", held.alias("held"), "text"), run, "doc_id bigint, held_out boolean, lang_pred string, score double, n_letters bigint, n_phrases bigint", "langid")


def is_held_out(doc_id: F.Column) -> F.Column:
    return remainder(doc_id, 4) == 2

import re
from collections import Counter

import ahocorasick
import numpy as np

from corvane.llm import divergence, oracles, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, value string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top):
    """The contract, cell by cell: rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [[re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t) for t in TERM.findall(text)] for text, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(t, s) for t, (_, x, s) in zip(terms, rows, strict=True) if x == lang]
        df = Counter(t for ts, _ in own for t in set(ts))
        kept = [t for t, n in df.items() if n >= least]
        n = {s: Counter(t for ts, x in own if x == s for t in ts if df[t] >= least) for s in {s for _, s in own}}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in n.items()}, share(sum(n.values(), Counter()))
        for s in n:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in n if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, "y") for i, r in enumerate(rows)], SCHEMA).repartition(4)


def audited(spark, rows, least=3, top=50):
    return sorted(tuple(r) for r in divergence.audit(frame(spark, rows), least_docs=least, top=top).collect())


def some(rng, n, sources):
    words = ["the", "The", "THE", "über", "ÜBER", "漢字", "naïve", "x1y", "a", "b", "c-d", "e_f", "don't", "ééé", "😀", *(f"w{chr(97 + k)}" for k in range(20))]
    seps = [" ", "  ", "\n", "\x00", "7", "`", "[", ".", "\x7f", "@"]
    make = lambda: "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.integers(0, 30)))
    return [(make(), str(rng.choice(["en", "de", "x y"])), f"s{rng.integers(0, sources)}") for _ in range(n)]


ODD = [(None, None, None), (None, "en", None), ("", "en", "s1"), ("the the the", None, "s0"), ("word " * 40_000, "en", "s2"), ("the", "fr", "only"), ("1 2 3", "it", "p"), ("4", "it", "q"), (" \n", "en", "never any")]


def test_audits_as_the_contract_says(spark):
    rng = np.random.default_rng(4)
    rows = some(rng, 150, 4) + ODD + ODD[2:4]
    want = plain(rows, 3, 50)
    assert audited(spark, rows) == want and {r[2] for r in want} == {"pair", "term"}
    assert audited(spark, rows, top=2) == plain(rows, 3, 2)
    assert audited(spark, rows, least=10_000) == plain(rows, 10_000, 50)  # no term is kept: pairs of value 0
    assert audited(spark, []) == []


def test_blocks_of_terms_and_sources_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = some(rng, 200, 9)
    want = plain(rows, 3, 50)
    monkeypatch.setattr(divergence, "BLOCK", 5)
    monkeypatch.setattr(divergence, "TERMS", 6)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    assert audited(spark, rows) == want
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", -1)
    assert audited(spark, rows) == want


def test_shares_are_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(4 * 10**12, 9 * 10**12, 7)], "n bigint, total bigint, v bigint")
    assert big.select(divergence._share(*(big[c] for c in ("n", "total", "v"))).alias("p")).first().p == 1 + 10**9 * (4 * 10**12 + 5) // (9 * 10**12 + 35)


def test_automaton_counts_whole_terms():
    found = divergence.automaton(["a", "ab", "b", "é"])
    assert isinstance(found, ahocorasick.Automaton)
    assert divergence.occurrences(found, "a  a ab b é éa".encode(), 5).tolist() == [2, 1, 1, 1, 0]


def test_document_counts_compare_bytes(monkeypatch):
    """With a hash that tells lengths only, terms of one length are still kept apart."""
    monkeypatch.setattr(divergence.K, "span_hash", lambda data, starts, ends: (ends - starts).astype(np.uint64) + np.uint64(1))
    one, two, three = "abcdefghi", "abcdefghj", "jihgfedcba"
    texts, langs = [f"{one} {two} {one} {three}", f"{two} {two}", f"{three} {one}", ""], ["en", "en", "de", "de"]
    found = divergence.DocumentCounts()
    for _ in range(2):
        data, off, _valid = divergence.K.utf8(divergence.pa.array(texts))
        found.add(langs, data, off)
    got = Counter()
    for lang, terms, n in found.batches():
        for t, k in zip(terms.to_pylist(), n, strict=True):
            got[lang, t.decode()] += int(k)
    assert got == {("en", one): 2, ("en", two): 4, ("en", three): 2, ("de", one): 2, ("de", three): 2}


def test_equals_sql(spark, sf, duck):
    want = sorted(duck.execute(oracles.DIVERGENCE).fetchall())
    names = [c[0] for c in duck.description]
    assert sorted(tuple(r) for r in queries.op12_source_divergence(spark, sf).select(*names).collect()) == want and want

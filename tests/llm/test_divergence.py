import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import CLASHES, SCHEMA
from vitalspark.llm import divergence
from vitalspark.llm import words as W

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=3, top=200):
    """Rows of audit() by the definition; rows: (text, lang, source)."""
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        sources[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in own}, shares(whole)
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked if part == "pair" else ranked[:top])]
    return sorted(out)


def got(docs, **more):
    return sorted(map(tuple, divergence.audit(docs, **more).collect()))


def test_odd(odd, empty):
    want = brute([(r.text, r.lang, r.source) for r in odd.collect()])
    assert got(odd) == want and {x[2] for x in want} == {"pair"}
    assert got(empty) == []


@pytest.mark.parametrize("bounds", [{}, {"TEXT_BYTES": 64, "TRIE_COUNTERS": 20, "CELLS": 6}])
def test_against_brute_force(spark, monkeypatch, bounds):
    """Also with tries that are handed on all the time, and walks and sums of a few cells."""
    for k, v in bounds.items():
        monkeypatch.setattr(divergence, k, v)
    random = np.random.default_rng(4)
    stems = ["a", "an", "ant", "anté", "Ant", "été", "é", "z", "zz", "日本", "日", "\U0001d11e", "x1y", "b_c"]
    rows = []
    for i in range(120):
        text = " ".join(random.choice(stems, random.integers(0, 30), p=np.r_[0.4, np.full(13, 0.6 / 13)]))
        rows.append((i, text, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s3", "s4"][int(random.integers(5))], len(text)))
    rows += [(200, "the", "xx", "only", 3), (201, None, "yy", "one", None), (202, "q", "yy", "two", 1)] + [rows[1]] * 5
    docs = spark.createDataFrame([(*r, *CLASHES.values()) for r in rows], SCHEMA).repartition(4)
    want = brute([(r[1], r[2], r[3]) for r in rows])
    assert got(docs, top=3) == brute([(r[1], r[2], r[3]) for r in rows], top=3)
    assert got(docs) == want and {x[2] for x in want} == {"pair", "term"} and ("yy", "one", "pair", "two", 0, 1) in want


def test_tries_merge():
    texts = ["to tea ten", "Tea tEN inn", "", "i in inn \xe9t\xe9", "to"]

    def trie(some, groups):
        _, _, data, offsets = next(W.slices(pa.array(some), 1 << 20))
        return divergence.count(data, offsets, np.array(groups))

    whole, parts = trie(texts, [0, 1, 0, 1, 0]), divergence.merge([trie(texts[:2], [0, 1]), trie(texts[2:], [0, 1, 0])])
    assert whole.terms.to_pylist() == sorted(whole.terms.to_pylist()) == ["i".encode(), b"in", b"inn", b"tea", b"ten", b"to", "été".encode()]
    assert parts.terms.equals(whole.terms) and all((a == b).all() for a, b in zip(parts[1:], whole[1:], strict=True))


def test_share_is_exact():
    for n, total, kept in ((0, 0, 1), (10**14, 3 * 10**14, 7), (123456789012, 9 * 10**14, 10**6)):
        assert divergence.share(np.array([n]), total, kept)[0] == 1 + 1_000_000_000 * (n + 1) // (total + kept)

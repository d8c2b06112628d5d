import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import row_groups
from vitalspark.llm import ranked_search
from vitalspark.llm import words as W

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    """Rows of rank() by the definition; docs: (doc_id, text), items: (item_id, text)."""
    found = [(i, Counter(terms(t))) for i, t in docs]
    full = [(i, c, sum(c.values())) for i, c in found if c]
    n, words = len(full), sum(x[2] for x in full)
    df = Counter(t for _, c, _ in full for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, size in full:
            m = 25 + 75 * size * n // words
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in Counter(terms(text)).items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return Counter(out)


ITEMS = [(1, "w7x w8x W9X w10x w10x"), (2, "the w5x"), (3, None), (4, ""), (5, "nowhere"), (6, "one TWO three"), (7, " ".join(f"w{i}x" for i in range(300))), (None, "année école"), (1, "w7x w8x W9X w10x w10x"), (1, "one"), (8, "same")]


def test_odd(spark, odd, empty):
    items = spark.createDataFrame([(*x, 1, "y") for x in ITEMS], "item_id long, text string, doc_id int, score string")
    want = brute([(r.doc_id, r.text) for r in odd.collect()], ITEMS)
    for shard in (1 << 22, 2000):
        assert Counter(map(tuple, ranked_search.rank(odd, items, shard_bytes=shard).collect())) == want
    assert ranked_search.rank(empty, items).collect() == [] and ranked_search.rank(odd, items.limit(0)).collect() == []


@pytest.mark.parametrize("group_terms", [2_000_000, 12])
def test_against_brute_force(spark, group_terms):
    """Many documents in few shards, so that lists become non-essential; also with items in several groups."""
    random = np.random.default_rng(8)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    docs = [(i, " ".join([*random.choice(common, random.integers(0, 60)), *random.choice(rare, random.integers(0, 4))])) for i in range(3000)]
    items = [(i, " ".join([*random.choice(common, 6), *random.choice(rare, 3)])) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    index = ranked_search.build_index(frame, 1 << 15)
    assert 3 < index.count() < 60
    found = ranked_search.search(index, ranked_search.item_terms(wanted), group_terms=group_terms).select("item_id", "doc_id", "score").collect()
    best = {}
    for r in found:
        best.setdefault(r.item_id, []).append((-r.score, r.doc_id))
    got = Counter((i, k + 1, d, -s) for i, rows in best.items() for k, (s, d) in enumerate(sorted(rows)[:10]))
    assert got == brute(docs, items)


def test_non_essential_postings_are_left_alone():
    """A rare term and a common one: once ten documents with both are known, the common list is only probed."""
    n = 20_000
    rare, common = np.arange(0, n, 200), np.arange(n)
    docs, times = [common, rare], [np.ones(n, np.int64), np.full(len(rare), 3)]
    factor = np.full(n, 100, np.int64)
    bounds = np.array([10 * ranked_search.effect(np.array([1]), factor[:1])[0], 5000 * ranked_search.effect(np.array([3]), factor[:1])[0]])
    scores, places, read = ranked_search.best(ranked_search.Lists(bounds, np.cumsum(bounds), [10, 5000], docs, times), factor, np.arange(n))
    assert places.tolist() == rare[:10].tolist() and len(set(scores.tolist())) == 1
    assert read < 0.2 * n


def test_shard_row_groups(spark):
    """A reader decodes a row group's shards together: however many shards a task makes, each has a row group of its own."""
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat(concat('w', id, ' x '), 100) AS text").coalesce(1)
    index = ranked_search.build_index(docs, 20_000)
    groups = row_groups(index)
    assert sum(groups) == index.count() > 5
    assert max(groups) == 1


def test_shards_are_tokenized_in_slices(spark, monkeypatch):
    """A shard of many slices: no call of the tokenizer gets more than a slice of its text, and words are those of one call."""
    texts = pa.array([None if i % 50 == 3 else f"Word{i} the\u00e9 x " * 300 for i in range(900)])
    ((_, _, data, offsets),) = W.slices(texts, 1 << 30)
    want = W.tokenize(data, offsets, W.ALNUM_WORDS, lower=True)
    sizes, tokenize = [], W.tokenize
    monkeypatch.setattr(W, "tokenize", lambda data, *a, **b: sizes.append(len(data)) or tokenize(data, *a, **b))
    hashes, of = W.word_hashes(texts[5:], W.ALNUM_WORDS, lower=True)
    late = want.doc >= 5
    assert (hashes == want.hash[late]).all() and (of + 5 == want.doc[late]).all()
    assert len(sizes) > 5 and max(sizes) <= W.SLICE_BYTES
    assert [len(x) for x in W.word_hashes(texts[:0], W.ALNUM_WORDS, lower=True)] == [0, 0]

import re
import time
from collections import Counter

import pytest

from tests.llm.conftest import words
from vitalspark.llm import near_dedup, spotsigs, substring_dedup

SPACE = re.compile("[^\\x20\\x09-\\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_substrings(rows, window=35):
    split = [SPACE.findall(r.text or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = Counter()
    for r, w in zip(rows, split):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[r.doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (2, 2), (3, 2)])
def test_substring_dedup(odd, batches, fanout):
    got = substring_dedup.dedup(odd, batches=batches, fanout=fanout).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_substrings(odd.collect())


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.dedup(empty).collect() == []


def test_index_compacts(spark, odd):
    from vitalspark.llm.common import new_folder

    index = substring_dedup.FingerprintIndex(spark, new_folder(spark, "index"), fanout=2)
    counts = substring_dedup.fingerprint_counts(odd)
    first = {r.h for r in index.add(counts).collect()}
    again = {r.h for r in index.add(counts).collect()}
    assert len(index.levels[0]) == 0 and len(index.levels[1]) == 1 and len(index.runs()) == 1
    every = {r.h: r.n for r in counts.collect()}
    assert first == {h for h, n in every.items() if n > 1} and again == set(every)
    assert {r.h: r.n for r in index.runs()[0].collect()} == {h: 2 * n for h, n in every.items()}


def brute_near(rows):
    sets = {}
    for i, r in enumerate(rows):
        w = SPACE.findall((r.text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = {i: r.doc_id for i, r in enumerate(rows)}
    parent = {d: d for d in ids.values() if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and ids[i] is not None and ids[j] is not None and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(ids[i]), find(ids[j])
                parent[max(a, b)] = min(a, b)
    return Counter((d, len(sets[i]), None if d is None else find(d), d is None or find(d) == d) for i, d in ids.items())


def test_near_duplicates(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(odd.collect())


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).collect() == []


def test_crowded_regions(spark, monkeypatch):
    """Near copies of very unlike degree, in regions so small that the forest has to go deep."""
    import random

    monkeypatch.setattr(near_dedup, "REGION", 8)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(120):
        w = base.copy()
        for _ in range(i % 7):
            w[rng.randrange(150)] = f"e{rng.random()}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts + [(500 + i, f"lone text number {i} of its own kind {i * i}") for i in range(30)], "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(docs.collect())


def test_pairs_in_a_boilerplate_crowd(spark, monkeypatch):
    """Texts that share a boilerplate but aren't linked by it, and among them pairs that are linked with each other only."""
    import random

    monkeypatch.setattr(near_dedup, "REGION", 8)
    rng = random.Random(4)
    texts = []
    for i in range(0, 160, 2):
        own = [f"w{rng.random()}" for _ in range(30)]
        other = own.copy()
        for j in (3, 9, 15, 21):
            other[j] = f"e{rng.random()}"
        texts += [(k, " ".join([f"b{j}" for j in range(120)] + w)) for k, w in ((i, own), (i + 1, other))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_near(docs.collect())
    assert len({x[2] for x in want}) == 80
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_spotsigs(odd, empty):
    import hashlib

    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in odd.collect()))
    want = Counter()
    for i, (_, _, text, doc_id) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][2]
        q = len(text) // 4
        want[doc_id, len(text), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()] += 1
    got = spotsigs.compare_edited(odd).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[3] and prints[5] == prints[6] and prints[1] != prints[11]
    assert Counter((r.doc_id, r.fingerprint) for r in spotsigs.fingerprints(odd).collect()) == Counter((r.doc_id, r.fingerprint) for r in got)
    assert spotsigs.compare_edited(empty).collect() == []


def test_spotsigs_one_row(spark):
    row = spotsigs.compare_edited(spark.createDataFrame([(4, "the quick fox was a sly old fox")], "doc_id long, text string")).collect()[0]
    assert row.near_next == 1.0 and row.n_chars == 31


def test_spotsigs_similar(spark, odd):
    import base64

    import numpy as np

    members, pairs = spotsigs.similar(spotsigs.fingerprints(odd), 0.5)
    by = {r.fingerprint: np.frombuffer(base64.b64decode(r.fingerprint.split(":")[1]), "<u4") for r in spotsigs.fingerprints(odd).collect()}
    want = sum(spotsigs.likeness(by[a], by[b]) >= 0.5 for a in by for b in by if a < b and len(by[a]) and len(by[b]))
    assert pairs.count() == want and members.count() == odd.count()


def boilerplate_crowd(groups: int, alike: int) -> list[tuple[int, str]]:
    """Documents that share 60 words, in groups of three of which the first two are linked at 0.75 to 0.8 and the third isn't, and `alike` copies of a long text with another last word, but for a few with changed words all through."""
    import random

    rng = random.Random(11)
    shared = [f"b{i}" for i in range(60)]
    out = []
    for g in range(groups):
        own = [f"g{g}w{i}" for i in range(50)]
        near, far = own.copy(), own.copy()
        near[25] = near[5] = "x"  # ten of 106 shingles: 96 of 116 shared
        for i in range(2, 50, 8):
            far[i] = "y"
        out += [shared + own, shared + near + ["end"] * rng.randrange(3), shared + far]
    long = [f"l{i}" for i in range(400)]
    for k in range(alike):
        out.append([*long, f"last{k}"])
    for k in range(20):  # linked with half of its own kind, and with none of the others
        out.append([w if i % 9 or i > 40 * (k % 10) + 90 else f"z{i}" for i, w in enumerate(long)] + [f"own{k}"])
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("region", [near_dedup.REGION, 16])
def test_near_duplicates_in_crowds(spark, monkeypatch, region):
    """Regions crowded at every depth: no link is lost, however small regions are."""
    monkeypatch.setattr(near_dedup, "REGION", region)
    docs = spark.createDataFrame(boilerplate_crowd(250, 300), "doc_id long, text string")
    made = []
    parts = near_dedup._dealt
    monkeypatch.setattr(near_dedup, "_dealt", lambda rows: made.append(rows.groupBy("region").count().agg({"count": "max"}).first()[0]) or parts(rows))
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(docs.collect())
    assert max(made) <= region


def test_substring_hot_rows(spark):
    """A row that stands ten thousand times takes seconds: rows alike share one list of places."""
    text = " ".join(words(31, 200))
    docs = spark.createDataFrame([(1, text), (2, " ".join(words(32, 60)))], "doc_id long, text string")
    many = docs.where("doc_id = 1").crossJoin(spark.range(10_000)).select("doc_id", "text").union(docs.where("doc_id = 2"))
    began = time.time()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(many).collect())
    assert got == {(1, 200, 200, ""): 10_000, (2, 60, 0, docs.where("doc_id = 2").first().text): 1} and time.time() - began < 60

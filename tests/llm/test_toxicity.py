import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from vitalspark.llm import toxicity


def plain_score(model, text, bits=toxicity.BITS):
    """Score of a text by the sum over all pairs."""
    (_, found), = toxicity.features(pa.array([text]), bits) if text else ((0, toxicity.Features(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1))),)
    at = [int(np.searchsorted(model.slots, s)) for s in found.slot if s in set(model.slots.tolist())]
    x = toxicity.WEIGHT / np.sqrt(max(1, found.n[0]))
    raw = model.bias + sum(model.weights[i] * x for i in at)
    raw += sum(float(model.factors[a] @ model.factors[b]) * x * x for k, a in enumerate(at) for b in at[k + 1 :])
    return 1 / (1 + np.exp(-raw))


def test_gradient_is_the_loss_gradient():
    random = np.random.default_rng(1)
    model = toxicity.Model(np.arange(5), -0.3, random.normal(0, 1, 5), random.normal(0, 1, (5, 3)))
    doc, at = np.array([0, 0, 0, 2, 2, 3]), np.array([0, 2, 4, 1, 2, 3])
    rows, y = toxicity.Rows(doc, at, random.uniform(0.2, 1, 6), 4), np.array([1, 0, 0, 1])

    def loss(m):
        p = toxicity.chance(m.raw(rows)[0])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    flat = lambda m: np.r_[m.bias, np.c_[m.weights, m.factors].ravel()]

    def model_of(v):
        table = v[1:].reshape(5, 4)
        return toxicity.Model(model.slots, v[0], table[:, 0], table[:, 1:])

    base = flat(model)
    numeric = [(loss(model_of(base + h)) - loss(model_of(base - h))) / 2e-6 for h in np.eye(len(base)) * 1e-6]
    assert np.allclose(model.gradient(rows, y), numeric, atol=1e-4)


def test_learns_pairs(spark):
    """Neither word is toxic alone; both together are: no sum of weights that knows each word's share can say so."""
    random = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        a, b = (i // 2) % 2, i % 2
        words = [f"{random.choice(list('bcdfgh'))}{random.integers(60)}" for _ in range(6)] + ["grrr"] * a + ["folk"] * b
        random.shuffle(words)
        rows.append((i, " ".join(words), a & b))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    tested = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert len(tested) > 150 and np.mean([a == b for a, b in tested]) > 0.98
    model = toxicity.fit(docs, labels.where("crc32(CAST(doc_id AS string)) % 5 <> 0"))
    for i, text, _ in rows[:40]:
        assert abs(got[i].score - plain_score(model, text)) < 1e-6


def test_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (11, 1), (14, 0), (20, 0), (7, 0), (8, None), (None, 1), (99, 0), (1, 1)], "doc_id long, toxic int")
    got = toxicity.classify(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.classify(empty, labels).collect() == []
    assert {r.score for r in toxicity.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in toxicity.classify(odd, labels.where("toxic = 1")).collect()} == {1}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    tested = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(tested) > 500 and np.mean([a == b for a, b in tested]) > 0.98
    assert np.mean([p for y, p in tested if y]) > 0.9 and np.mean([p for y, p in tested if not y]) < 0.005

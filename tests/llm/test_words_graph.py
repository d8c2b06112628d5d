import re

import numpy as np
import pyarrow as pa

from vitalspark.llm import words as W
from vitalspark.llm.graph import components, extend

TEXTS = ["", None, "a", "  A bé\nc\u0085d ", "x" * 70, "\x00 \x1f1-2", "L'ÉCOLE 9z_\U0001d11e"]


def test_words_are_those_of_the_patterns():
    for classes, pattern, lower in ((W.SPACE_WORDS, "[^\\x20\\x09-\\x0D]+", False), (W.ALNUM_WORDS, "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", True)):
        for limit in (1, 10, 1 << 20):
            got = []
            for low, high, data, offsets in W.slices(pa.array(TEXTS), limit):
                t = W.tokenize(data, offsets, classes, lower)
                raw = data.tobytes()
                for i in range(high - low):
                    got.append([raw[a:b].decode() for a, b, d in zip(t.start, t.end, t.doc) if d == i])
            ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            want = [re.findall(pattern, (x or "").translate(ascii_lower) if lower else (x or "")) for x in TEXTS]
            assert [[w.translate(ascii_lower) if lower else w for w in x] for x in got] == want


def test_hash_depends_on_the_words_alone():
    data = np.frombuffer(b"one two  ONE\ttwo one", np.uint8)
    t = W.tokenize(data, np.array([0, 8, 20]), W.SPACE_WORDS, True)
    assert t.hash[0] == t.hash[2] == t.hash[4] != t.hash[1] and t.doc.tolist() == [0, 0, 1, 1, 1]
    sums = W.prefix_sums(t.hash)
    assert W.span_hash(sums, np.array([0]), np.array([2])) == W.span_hash(sums, np.array([2]), np.array([4]))


def _brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    mixed = [(5, 3), (3, 9), (9, 5), (1, 1), (300, 140), (401, 400)]
    edges = chain + star + mixed + star[:5]
    want = {k: v for k, v in _brute(edges).items() if k != 1}
    frame = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.component for r in components(frame).collect()} == want
    more = [(140, 7), (500, 501), (501, 3)]
    known = extend(extend(None, frame), spark.createDataFrame(more, "u long, v long"))
    assert {r.node: r.component for r in known.collect()} == {k: v for k, v in _brute(edges + more).items() if k != 1}
    assert extend(None, spark.createDataFrame([], "u long, v long")).count() == 0

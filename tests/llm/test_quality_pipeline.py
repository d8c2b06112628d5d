import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import row_groups
from tests.llm.test_dedup import brute_near
from tests.llm.test_scans import brute_decontaminate
from vitalspark.llm import decontaminate, quality, secrets

SF = "/root/testdata/sf0.001"


def test_pool():
    got = quality.pool(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.ones(5))
    assert np.allclose(got, [0.1, 1 / 3, 1 / 3, 1 / 3, 0.9])


def test_held_out_accuracy(spark):
    folder = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    tested = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(tested) > 50 and np.mean([a == b for a, b in tested]) > 0.97


def test_classify_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 1), (11, 1), (14, 0), (20, 0), (7, 0), (8, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.classify(empty, labels).collect() == []
    none = quality.classify(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    kept = quality.keep_good(odd, labels)
    assert kept.dtypes == odd.dtypes and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage over the smallest tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).cache()
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_columns(stages):
    assert [n for n, _, _ in stages] == [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(stages) <= 5
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_stages_do_what_plain_versions_do(spark, stages):
    (_, docs, good), (_, _, single), (_, _, clean), (_, _, plain), (_, _, ids) = stages
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.03 * len(labels)
    assert {r.doc_id for r in single.collect()} == {d for (d, _, _, k) in brute_near(good.collect()) if k}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert {r.doc_id for r in clean.collect()} == {d for (d, _, hit, _, _) in brute_decontaminate(single.collect(), items) if not hit}
    want = {r.doc_id: secrets.redacted(r.text, secrets.find(r.text)[1]) for r in clean.collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in plain.collect()} == {i: (t, len(t)) for i, t in want.items()}
    import sentencepiece

    from vitalspark.llm.common import tokenizer_file

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert {r.doc_id: (r.ids, r.n_ids, r.same) for r in ids.collect()} == {i: (model.encode(t), len(model.encode(t)), True) for i, t in want.items()}


def test_run_is_the_stages(spark, stages):
    digest = lambda rows: sorted((r.doc_id, hashlib.sha256(str(r.ids).encode()).hexdigest()) for r in rows)
    assert digest(corpus_pipeline.run(spark, SF).collect()) == digest(stages[-1][2].collect())


def test_stages_take_odd_rows(spark, odd, empty):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "h", "key")
    for start in (docs, empty.select(docs.columns)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, start, SF).count() <= start.count()


def test_decontamination_stage_holds_few_blocks(spark, monkeypatch):
    """A task of many blocks, as of a large file split: what the stage writes of them can be read a few blocks at a time."""
    tables, write = {}, decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda spark, frame, name, **b: tables.setdefault(name, write(spark, frame, name, **b)))
    docs = spark.range(24).selectExpr("id AS doc_id", "repeat(concat('w', id, ' x '), 60000) AS text").coalesce(1)
    assert corpus_pipeline.decontamination_stage(spark, docs, SF).count() == 24
    groups = row_groups(tables["postings"])
    assert sum(groups) == 24 and max(groups) <= 8

"""Toxicity: a factorization machine over hashed terms.

Features are the distinct terms of a text and their beginnings (an insult keeps its stem when its
ending changes), hashed into a fixed number of slots.  The slots that labels tell apart most, by
the likelihood ratio of their counts over all labelled rows, are the model's.  Its score is

    bias + sum of weights + sum over pairs of slots of the product of their factors,

so that two terms can count together what neither counts alone.  Every round adds up the gradient over
all labelled rows, each partition its part, and the driver moves the parameters, of a size set by the
number of slots and factors.  A text's features weigh less the more of them it has, so that long
texts are no more toxic for their length.

Null and empty texts have no features and the bias for a score.  Of several labels of a doc_id the
mean counts, from 0.5 on as 1; null labels are left out.  Without labels the score is 0.5, with
labels of one kind only it is theirs.  Repeated rows each have their score, and are learnt from as
often as they stand.  A row without doc_id is never labelled.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.llm import words as W
from vitalspark.llm.common import small_batches, sized, written

#: Bits of a slot; bytes of a term's beginnings that are features; most slots of the model, the least likelihood ratio (chi-squared at 0.001) and rows they need; factors.
BITS, BEGINNINGS, SLOTS, LEAST_RATIO, LEAST_ROWS, FACTORS = 18, (3, 4, 5, 6, 7, 8), 4096, 10.83, 5, 4
#: Rounds, step, decay of parameters, size of the first factors, and what a text's features weigh together (the square root of it).
ROUNDS, STEP, DECAY, FIRST, WEIGHT = 40, 0.1, 1e-6, 0.02, 10.0


class Features(NamedTuple):
    """Slots of some texts, those of a text together and distinct: text, slot; and how many each text has."""

    doc: np.ndarray
    slot: np.ndarray
    n: np.ndarray


def features(texts: pa.Array, bits: int = BITS, beginnings: tuple[int, ...] = BEGINNINGS) -> Iterator[tuple[int, Features]]:
    """(first row, features) of runs of texts."""
    for low, high, data, offsets in W.slices(texts):
        words = W.tokenize(data, offsets, W.LETTER_WORDS, lower=True)
        sums = W.byte_sums(W.lowered(data))
        hashes, docs = [words.hash], [words.doc]
        for k, size in enumerate(beginnings):
            longer = np.flatnonzero(words.end - words.start > size)
            hashes.append(W.mix(W.span_hash(sums, words.start[longer], words.start[longer] + size) + np.uint64(k + 1)))
            docs.append(words.doc[longer])
        slot = (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)
        doc, slot = np.divmod(np.unique((np.concatenate(docs) << bits) | slot), 1 << bits)
        yield low, Features(doc, slot, np.bincount(doc, minlength=high - low))


class Model(NamedTuple):
    """Slots in order, with the bias, their weights and factors."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def seen(self, found: Features) -> Rows:
        """What the model sees of some texts."""
        at = np.minimum(np.searchsorted(self.slots, found.slot), max(0, len(self.slots) - 1))
        hit = self.slots[at] == found.slot if len(self.slots) else np.zeros(len(at), bool)
        doc = found.doc[hit]
        return Rows(doc, at[hit], WEIGHT / np.sqrt(found.n[doc]), len(found.n))

    def raw(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores, the sum of each text's factors, and the factors of each feature."""
        each = self.factors[rows.at] * rows.value[:, None]
        total = np.stack([np.bincount(rows.doc, x, rows.n) for x in each.T], axis=1) if rows.n else np.zeros((0, each.shape[1]))
        pairs = 0.5 * ((total**2).sum(axis=1) - np.bincount(rows.doc, (each**2).sum(axis=1), rows.n))
        return self.bias + np.bincount(rows.doc, self.weights[rows.at] * rows.value, rows.n) + pairs, total, each

    def gradient(self, rows: Rows, y: np.ndarray) -> np.ndarray:
        """Sum over texts of the log loss's gradient: bias, then weight and factors of each slot; and the loss."""
        raw, total, each = self.raw(rows)
        p = chance(raw)
        off = (p - y)[rows.doc] * rows.value
        cells = [np.bincount(rows.at, off, len(self.slots))] + [np.bincount(rows.at, off * (total[rows.doc, j] - each[:, j]), len(self.slots)) for j in range(each.shape[1])]
        return np.r_[(p - y).sum(), np.stack(cells, axis=1).ravel()]


class Rows(NamedTuple):
    """Features that a model knows: text, place of the slot in the model, value; and the number of texts."""

    doc: np.ndarray
    at: np.ndarray
    value: np.ndarray
    n: int


def chance(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def likelihood_ratio(n0: np.ndarray, n1: np.ndarray, rows0: int, rows1: int) -> np.ndarray:
    """G squared of a slot's counts among the labelled rows of either kind."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    n, rows = n0 + n1, rows0 + rows1
    return 2 * (part(n0, n * rows0 / rows) + part(n1, n * rows1 / rows) + part(rows0 - n0, (rows - n) * rows0 / rows) + part(rows1 - n1, (rows - n) * rows1 / rows))


def _counted(labelled: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, counts among rows of label 0 and 1); the last slot, 1 << bits, counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(((1 << bits) + 1) * 2, np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy().astype(np.int64)
            counts[-2:] += np.bincount(y, minlength=2)
            for low, found in features(batch.column(1), bits):
                counts += np.bincount(found.slot * 2 + y[low + found.doc], minlength=len(counts))
        some = np.flatnonzero(counts.reshape(-1, 2).sum(axis=1))
        yield pa.record_batch({"slot": pa.array(some, pa.int32()), "n0": pa.array(counts[0::2][some]), "n1": pa.array(counts[1::2][some])})

    got = labelled.mapInArrow(run, "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST_ROWS).toArrow()
    return got.column("slot").to_numpy().astype(np.int64), np.stack([got.column(c).to_numpy() for c in ("n0", "n1")], axis=1)


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, slots: int = SLOTS, factors: int = FACTORS, rounds: int = ROUNDS) -> Model:
    """Model from docs (doc_id, text) and labels (doc_id, toxic) of those to learn from."""
    spark = docs.sparkSession
    known = written(spark, labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y")), "labels")
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized(known), "doc_id").select("y", "text")
    slot, counts = _counted(labelled, bits)
    rows = counts[slot == 1 << bits]
    n0, n1 = map(int, rows[0]) if len(rows) else (0, 0)
    none = Model(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, factors)))
    if not n0 or not n1:
        return none._replace(bias=0.0 if not len(rows) else 50.0 if n1 else -50.0)
    terms = slot < 1 << bits
    slot, counts = slot[terms], counts[terms]
    ratio = likelihood_ratio(counts[:, 0], counts[:, 1], n0, n1)
    best = np.lexsort((slot, -ratio))
    best = best[ratio[best] >= LEAST_RATIO][:slots]
    chosen = np.sort(slot[best])
    random = np.random.default_rng(12)
    model = Model(chosen, float(np.log(n1 / n0)), np.zeros(len(chosen)), random.normal(0, FIRST, (len(chosen), factors)))
    seen = written(spark, _seen(labelled, model, bits), "seen")
    return _descend(seen, model, n0 + n1, rounds)


def _seen(labelled: DataFrame, model: Model, bits: int) -> DataFrame:
    """(y, at, value): what the model sees of each labelled row."""
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found in features(batch.column(1), bits):
                rows = sent.value.seen(found)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows.doc, np.arange(rows.n + 1)), pa.int32()), pa.array(rows.at, pa.int32()))
                yield pa.record_batch({"y": batch.column(0).slice(low, rows.n), "at": lists, "value": pa.array(WEIGHT / np.sqrt(np.maximum(found.n, 1)))})

    return labelled.mapInArrow(run, "y int, at array<int>, value double")


def _descend(seen: DataFrame, model: Model, n: int, rounds: int) -> Model:
    """The model after some rounds of Adam on the whole gradient."""
    size = 1 + model.factors.size + len(model.slots)
    width = model.factors.shape[1] + 1
    parameters = np.r_[model.bias, np.c_[model.weights, model.factors].ravel()]
    steps = np.r_[1.0, np.tile(np.r_[1.0, np.full(width - 1, 0.2)], len(model.slots))]
    first, second = np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        sent = seen.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                at = batch.column(1)
                doc = np.repeat(np.arange(len(batch)), at.value_lengths().to_numpy())
                total += sent.value.gradient(Rows(doc, at.flatten().to_numpy(), batch.column(2).to_numpy()[doc], len(batch)), batch.column(0).to_numpy())
            yield pa.record_batch({"cell": pa.array(np.arange(size), pa.int32()), "value": pa.array(total)})

        cells = seen.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        gradient = np.zeros(size)
        gradient[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
        sent.unpersist()
        gradient = gradient / n + DECAY * np.r_[0.0, parameters[1:]]
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        parameters = parameters - STEP * steps * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        table = parameters[1:].reshape(-1, width)
        model = model._replace(bias=float(parameters[0]), weights=table[:, 0].copy(), factors=table[:, 1:].copy())
    return model


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """doc_id, score for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, found in features(batch.column(1), bits):
                rows = sent.value.seen(found)
                yield pa.record_batch({"doc_id": batch.column(0).slice(low, rows.n), "score": pa.array(chance(sent.value.raw(rows)[0]))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0: such rows' labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels: (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    learnt = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, learnt))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

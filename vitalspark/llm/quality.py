"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of all texts are made once and standardised by their mean and deviation over all
documents.  Random Fourier features approximate a Gaussian kernel on them.  Each partition adds up
its part of the normal equations; their sums, of a size set by the number of features, are solved
on the driver.  Labelled rows are split by a hash of the doc_id: most fit the ridge weights, the
rest the isotonic map from ridge score to probability, by pooling adjacent violators over a fixed
number of score bins.

Null and empty texts have statistics of zero and a score like any other.  Of several labels of a
doc_id the mean counts, from 0.5 on as 1; null labels are left out.  Without labels, or with one
kind only, the score is their mean, or 0.5.  Repeated rows each have their score.  A row without
doc_id is never labelled.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from vitalspark.llm import words as W
from vitalspark.llm.common import small_batches, written

#: Random features, kernel width in deviations, ridge strength per row, score bins of the calibration, share of labels that calibrate.
FEATURES, WIDTH, RIDGE, BINS, CALIBRATE = 256, 6.0, 1e-3, 512, 4

STATISTICS = (
    "log_chars log_words word_length upper lower digit other_letter space line_end mark symbol bar exclaim "
    "upper_words symbol_words distinct_words top_word repeated_runs log_line_length short_lines repeated_lines common_words entropy"
).split()

_COMMON = b"a an and are as at by de der des die das dem den ein el en et of on que que se the to un une und was with in is it la le les los il pour por con von mit auf for from be this that"


def _classes() -> dict[str, np.ndarray]:
    every = np.arange(256)

    def among(chars: bytes) -> np.ndarray:
        return np.isin(every, list(chars))

    return {
        "upper": (every >= 65) & (every <= 90),
        "lower": (every >= 97) & (every <= 122),
        "digit": (every >= 48) & (every <= 57),
        "other_letter": every >= 0xC0,
        "space": among(b" \t"),
        "line_end": every == 10,
        "mark": among(b".,;:'\"?-"),
        "symbol": among(b"*#$%&@^~<>{}[]\\/+=_"),
        "bar": every == 0x7C,
        "exclaim": every == 0x21,
    }


def statistics(texts: pa.Array) -> Iterator[np.ndarray]:
    """A row of STATISTICS for each text."""
    common = np.frombuffer(_COMMON, np.uint8)
    common_hashes = W.tokenize(common, np.array([0, len(common)]), W.ALNUM_WORDS, lower=True).hash
    for low, high, data, offsets in W.slices(texts):
        rows = high - low
        out = {k: np.zeros(rows) for k in STATISTICS}

        def total(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(values) + 1)
            np.cumsum(values, out=sums[1:])
            return sums[bounds[1:]] - sums[bounds[:-1]]

        size = np.diff(offsets)
        chars = np.maximum(total((data & 0xC0) != 0x80, offsets), 1)
        counts = {k: total(v[data], offsets) for k, v in _classes().items()}
        for k, v in counts.items():
            out[k] = v / chars
        share = np.stack([*counts.values(), np.maximum(chars - sum(counts.values()), 0)]) / chars
        out["entropy"] = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=0) * (size > 0)
        words = W.tokenize(data, offsets, W.SPACE_WORDS, lower=True)
        first = W.bounds(words.doc, rows)
        n = np.maximum(np.diff(first), 1)
        out["log_chars"], out["log_words"] = np.log1p(size), np.log1p(np.diff(first))
        out["word_length"] = np.minimum(total(words.end - words.start, first) / n, 50)
        ends = data[words.end - 1]
        out["symbol_words"] = total(_classes()["symbol"][ends], first) / n
        begins = data[words.start]
        out["upper_words"] = total(_classes()["upper"][begins] & _classes()["upper"][data[np.maximum(words.end - 1, 0)]], first) / n
        letters = W.tokenize(data, offsets, W.ALNUM_WORDS, lower=True)
        out["common_words"] = total(np.isin(letters.hash, common_hashes), W.bounds(letters.doc, rows)) / n
        sums = W.prefix_sums(words.hash)
        runs = W.whole(words.doc, 4)
        run_hash, run_first = W.span_hash(sums, runs, runs + 4), W.bounds(words.doc[runs], rows)
        line_end = np.flatnonzero(data == 10)
        line_start = np.union1d(offsets[:-1][size > 0], line_end[line_end + 1 < len(data)] + 1)
        line_stop = np.r_[line_start[1:], len(data)][: len(line_start)]
        line_doc = np.searchsorted(offsets, line_start, side="right") - 1
        line_hash, line_first = W.span_hash(W.byte_sums(data), line_start, line_stop), W.bounds(line_doc, rows)
        lines = np.maximum(np.diff(line_first), 1)
        out["log_line_length"] = np.log1p(size / lines)
        out["short_lines"] = total(line_stop - line_start < 25, line_first) / lines
        for i in range(rows):
            own = words.hash[first[i] : first[i + 1]]
            if len(own):
                kinds, times = np.unique(own, return_counts=True)
                out["distinct_words"][i], out["top_word"][i] = len(kinds) / len(own), times.max() / len(own)
            own = run_hash[run_first[i] : run_first[i + 1]]
            if len(own):
                out["repeated_runs"][i] = 1 - len(np.unique(own)) / len(own)
            own = line_hash[line_first[i] : line_first[i + 1]]
            if len(own):
                out["repeated_lines"][i] = 1 - len(np.unique(own)) / len(own)
        yield np.stack([out[k] for k in STATISTICS], axis=1)


@F.arrow_udf(ArrayType(FloatType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    """STATISTICS of each text; the other columns of its row stay in Spark."""
    parts = [x.astype(np.float32) for x in statistics(texts)]
    table = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.float32)
    return pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), table.shape[1]).cast(pa.list_(pa.float32()))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats (array<float> of STATISTICS) for each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics_of("text").alias("stats"))


class Model(NamedTuple):
    """Standardisation, random features, ridge weights, and the calibration's points (raw score, probability)."""

    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    probability: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -5, 5)
        return np.c_[np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones(len(z))]

    def raw_score(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_score(stats), self.raw, self.probability)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic (rising) least-squares fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, bins: int = BINS) -> Model:
    """Model from all documents' statistics (doc_id, stats) and labels (doc_id, quality) of those to learn from."""
    k = len(STATISTICS)
    moments = stats.select(*[x for i in range(k) for x in (F.avg(F.col("stats")[i]), F.stddev_pop(F.col("stats")[i]))]).first()
    mean, deviation = (np.array([x or 0.0 for x in moments[i::2]]) for i in (0, 1))
    random = np.random.default_rng(17)
    model = Model(mean, np.maximum(deviation, 1e-6), random.normal(0, 1 / width, (k, features)), random.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    # Repeated rows of a document count once.
    rows = written(stats.sparkSession, stats.join(known, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("stats").alias("stats")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE))), "labelled")
    counts = rows.agg(F.count("*"), F.sum("y")).first()
    if not counts[0] or counts[1] in (0, counts[0]):
        return model._replace(probability=np.full(2, 0.5 if not counts[0] else counts[1] / counts[0]))

    size = features + 1
    upper = np.triu_indices(size)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x = model.features(_matrix(batch.column(1)))
            gram += x.T @ x
            right += x.T @ batch.column(0).to_numpy()
        cells = np.r_[gram[upper], right]
        yield pa.record_batch({"cell": pa.array(np.arange(len(cells))), "value": pa.array(cells)})

    cells = rows.where("part > 0").select("y", "stats").mapInArrow(equations, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    values = cells.sort_values("cell")["value"].to_numpy()
    gram = np.zeros((size, size))
    gram[upper] = values[: len(upper[0])]
    gram += np.triu(gram, 1).T
    model = model._replace(weights=np.linalg.solve(gram + ridge * gram[-1, -1] / size * np.eye(size), values[len(upper[0]) :]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw_score(_matrix(batch.column(1)))
            yield pa.record_batch({"bin": pa.array(np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1).astype(np.int64)), "raw": pa.array(raw), "y": batch.column(0)})

    points = rows.where("part = 0").select("y", "stats").mapInArrow(binned, "bin long, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    if not len(points):
        return model._replace(raw=np.array([0.0, 1.0]), probability=np.array([0.0, 1.0]))
    level = pool(points["y"].to_numpy(), points["n"].to_numpy())
    # A sliver of the raw score keeps the order of rows within a level.
    raw = np.maximum.accumulate(points["raw"].to_numpy())
    return model._replace(raw=raw, probability=np.clip(0.998 * level + 0.002 * np.clip(raw, 0, 1), 0, 1))


def score(stats: Column, model: Model) -> Column:
    """The score of each row of statistics."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def scores(rows: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(_matrix(rows)) if len(rows) else np.zeros(0))

    return scores(stats)


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1: such rows' labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _learnt(stats: DataFrame, labels: DataFrame) -> Model:
    return fit(stats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out(F.col("doc_id"))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels: (doc_id, quality)."""
    stats = written(docs.sparkSession, document_statistics(docs), "statistics")
    scored = stats.select("doc_id", score(F.col("stats"), _learnt(stats, labels)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs, with all their columns, that a model learnt as for classify() scores 0.5 or more.  The statistics are made once, and written beside the rows."""
    small_batches(docs.sparkSession)
    name = "stats"
    while name in docs.columns:
        name += "_"
    rows = written(docs.sparkSession, docs.withColumn(name, statistics_of("text")), "statistics")
    stats = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("stats"))
    return rows.where(score(F.col(name), _learnt(stats, labels)) >= 0.5).select(docs.columns)

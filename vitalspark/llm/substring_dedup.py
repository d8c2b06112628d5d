"""Substring deduplication: a log-structured index of window fingerprints.

Every run of `window` consecutive words has a fingerprint: the least hash of the `gram`-word runs
inside it (leftmost of ties).  Equal windows have equal fingerprints at equal offsets, so a repeat
can't be missed; neighbouring windows mostly share theirs, so the index holds about one hash for
each dozen words.  The index is a list of immutable runs, each a Parquet table of (hash, count)
sorted by hash.  A new batch is merge-joined with the runs, then becomes a run; `fanout` runs are
compacted to one.  A hash seen twice only makes candidates: stretches of windows that share one
are verified by a second 64-bit hash of all their words, and where stretches differ, window by
window.

Words are [^\\x20\\x09-\\x0D]+ of the unchanged text.  Null and empty texts have no words; texts
shorter than a window lose nothing.  Repeated rows are places of their own, so all their windows
repeat.  A null doc_id is kept as it is.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.llm import words as W
from vitalspark.llm.common import delete, keyed, new_folder, partitions, written
from vitalspark.llm.graph import SALTS, salted_join

WINDOW, GRAM = 35, 8


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least of each `width` consecutive grams, by doubling."""
    at, size = np.arange(len(grams)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at = np.where(grams[a] <= grams[b], a, b)
        size += step
    return at


def stretches(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray] | None:
    """Runs of windows of one document with one fingerprint.

    h: fingerprint; c: hash of all words that the windows cover; o: words from the first window's
    start to the gram; m: windows; doc, a: document and first window's first word in it.
    """
    words = W.tokenize(data, offsets, W.SPACE_WORDS, lower=False)
    starts = W.whole(words.doc, window)
    if not len(starts):
        return None
    sums = W.prefix_sums(words.hash)
    every = np.arange(len(words.hash) - gram + 1)
    grams = W.span_hash(sums, every, every + gram)
    place = _least(grams, window - gram + 1)[starts]
    cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    a, m = starts[cut], np.diff(np.r_[cut, len(starts)])
    first = W.bounds(words.doc, len(offsets) - 1)
    doc = words.doc[a]
    return {"h": grams[place[cut]], "c": W.span_hash(sums, a, a + m + window - 1), "o": place[cut] - a, "m": m, "doc": doc, "a": a - first[doc]}


def fingerprint_counts(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h, n): the fingerprints of the windows of all texts and how many stretches have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in W.slices(batch.column(0)):
                found = stretches(data, offsets, window, gram)
                if found:
                    h, n = np.unique(found["h"], return_counts=True)
                    yield pa.record_batch({"h": h.view(np.int64), "n": n})

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class FingerprintIndex:
    """Immutable sorted runs of fingerprint counts in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2):
        self.spark, self.path, self.fanout, self.levels, self.made = spark, path, fanout, [[]], 0

    def _write(self, counts: DataFrame) -> str:
        self.made += 1
        run = f"{self.path}/run-{self.made:05d}"
        counts.repartition(partitions(self.spark), "h").sortWithinPartitions("h").write.parquet(run)
        return run

    def runs(self) -> list[DataFrame]:
        return [self.spark.read.parquet(x) for level in self.levels for x in level]

    def add(self, counts: DataFrame) -> DataFrame:
        """Take a batch's (h, n) in; return the hashes that the batch repeats, within itself or from an earlier batch."""
        history = self.runs()
        new = self._write(counts)
        batch = self.spark.read.parquet(new)
        found = batch.where("n > 1").select("h")
        for run in history:
            found = found.union(batch.join(run.select("h").hint("merge"), "h", "left_semi").select("h"))
        found = written(self.spark, found.distinct(), "repeated")
        self.levels[0].append(new)
        self._compact()
        return found

    def _compact(self) -> None:
        """Merge the runs of each full level into one run of the next; the merged ones go."""
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                whole = self.spark.read.parquet(*level).groupBy("h").agg(F.sum("n").alias("n"))
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(whole))
                for run in level:
                    delete(self.spark, run)
                level.clear()


def _candidates(docs: DataFrame, repeated: DataFrame, window: int, gram: int) -> DataFrame:
    """Stretches whose fingerprint is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, _, data, offsets in W.slices(batch.column(2)):
                x = stretches(data, offsets, window, gram)
                if x:
                    row = low + x["doc"]
                    yield pa.record_batch({"id0": ids[row], "key": keys[row], "h": x["h"].view(np.int64), "c": x["c"].view(np.int64), "o": x["o"].astype(np.int16), "m": x["m"].astype(np.int16), "a": x["a"].astype(np.int32)})

    found = docs.select("id0", "key", "text").mapInArrow(run, "id0 long, key long, h long, c long, o short, m short, a int")
    # A hash of a passage that a third of all documents share is spread over SALTS tasks.
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.hash("key", "a"), F.lit(SALTS))).join(salted, ["h", "salt"], "left_semi")


def repeated_places(docs: DataFrame, repeated: DataFrame, texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id0, key, places): for each text with repeated windows, array of (first window, windows)."""
    spark = docs.sparkSession
    stretch = ["h", "c", "o", "m"]
    found = written(spark, _candidates(docs, repeated, window, gram), "candidates")
    groups = written(spark, found.groupBy(*stretch).agg(F.count("*").alias("n"), F.min(F.struct("id0", "key", "a")).alias("one")), "stretches")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    whole = found.join(groups.where("n > 1").select(*stretch, salts.alias("salt")), [*stretch, "salt"], "left_semi").select("id0", "key", "a", "m")

    # Stretches that occur once, and one of each kind of those that differ from them: window by window.
    several = groups.groupBy("h").agg(F.count("*").alias("v")).where("v > 1").select("h")
    apart = salted_join(groups, several, ["h"], "left_semi").select("one.*", "m", "n", "h")
    asked = apart.groupBy("id0", "key").agg(F.collect_list(F.struct("a", "m", "n", "h")).alias("asked"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            for low, high, data, offsets in W.slices(batch.column(2)):
                words = W.tokenize(data, offsets, W.SPACE_WORDS, lower=False)
                first, sums = W.bounds(words.doc, len(offsets) - 1), W.prefix_sums(words.hash)
                part = lists.slice(low, high - low)
                doc = np.repeat(np.arange(high - low), np.diff(part.offsets.to_numpy()))
                x = part.flatten()
                a, m, n, h = (x.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                each = np.repeat(np.arange(len(a)), m)
                start = a[each] + np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)
                at = first[doc[each]] + start
                same = W.mix(W.span_hash(sums, at, at + window) ^ h[each].view(np.uint64))
                row = low + doc[each]
                yield pa.record_batch({"id0": ids[row], "key": keys[row], "w": same.view(np.int64), "start": start.astype(np.int32), "n": n[each]})

    asking = texts.join(asked, ["id0", "key"]).select("id0", "key", "text", "asked")
    windows = written(spark, asking.mapInArrow(expand, "id0 long, key long, w long, start int, n long"), "windows")
    twice = windows.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select("w", salts.alias("salt"))
    single = windows.where("n = 1").withColumn("salt", F.pmod(F.hash("key", "start"), F.lit(SALTS))).join(twice, ["w", "salt"], "left_semi")
    places = whole.union(single.select("id0", "key", F.col("start").alias("a"), F.lit(1).cast("short").alias("m")))
    # Rows alike have one list of places between them, however many they are.
    return places.distinct().groupBy("id0", "key").agg(F.collect_list(F.struct("a", "m")).alias("places"))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 2, fanout: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), for each row of docs.

    A word goes if a window that covers it repeats anywhere: all its places lose it.  The documents
    come in `batches` batches, as new ones would day by day, and the index takes them one by one.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    index = FingerprintIndex(spark, new_folder(spark, "index"), fanout)
    repeated = None
    for i in range(batches):
        found = index.add(fingerprint_counts(rows.where(F.pmod("key", F.lit(batches)) == i), window, gram))
        repeated = found if repeated is None else repeated.union(found)
    # Repeated rows share a key: their stretches count twice already, so that asking for both their texts changes nothing.
    places = repeated_places(rows, repeated.distinct(), rows, window, gram)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
                for text, places in zip(part.column(1), part.column(2), strict=True):
                    words = (text.as_py() or "").encode().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if places.is_valid:
                        a, m = (places.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                        np.add.at(gone, a, 1)
                        np.add.at(gone, a + m + window - 1, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - int(stay.sum()))
                    out["kept"].append(b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay)]).decode())
                yield pa.record_batch({"doc_id": part.column(0)} | {"n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.string())})

    return rows.join(places, ["id0", "key"], "left").select("doc_id", "text", "places").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")

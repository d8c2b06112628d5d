"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: each row is a block of documents with the posting lists of
all its terms (term hashes in order, and for each the ascending word positions in the block), so
that a search needs no shuffle of postings and a block can be searched again anywhere if an
executor is lost.  A search takes test phrases in groups of bounded size to every block.  In a
block a phrase with a missing term ends at once; for the others the lists, shifted by the term's
offset in the phrase, are intersected from the rarest term on.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased.  Null and empty texts have no
words and match nothing.  Repeated documents are documents of their own; repeated items count once.
An item with a null item_id hits words but is no item of the list.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm import words as W
from vitalspark.llm.common import without, written
from vitalspark.llm.graph import salted_join

WINDOW = 10
#: Bytes of text in a block, blocks in a row group of the index, and words of phrases that are sent to the executors at once (8 bytes each).
BLOCK_BYTES, GROUP_BLOCKS, PHRASE_WORDS = 1 << 19, 8, 4_000_000

INDEX = "block string, doc_ids array<long>, first array<int>, terms array<long>, starts array<int>, positions array<int>"


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Postings of every word of every text, a row for each block of documents, written in the shared folder.

    first: each document's first word, counted through the block, and the end; positions[starts[i]:starts[i+1]]
    are the places of terms[i].
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for low, high, data, offsets in W.slices(batch.column(1), block_bytes):
                words = W.tokenize(data, offsets, W.ALNUM_WORDS, lower=True)
                order = np.argsort(words.hash, kind="stable")
                ranked = words.hash[order]
                begins = np.flatnonzero(np.r_[np.full(min(1, len(ranked)), True), ranked[1:] != ranked[:-1]])
                ids = batch.column(0).slice(low, high - low)
                yield pa.record_batch(
                    {
                        "block": pa.array([f"{TaskContext.get().partitionId()}-{made}"]),
                        "doc_ids": pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), ids),
                        "first": _lists(W.bounds(words.doc, high - low), pa.int32()),
                        "terms": _lists(ranked[begins].view(np.int64), pa.int64()),
                        "starts": _lists(np.r_[begins, len(ranked)], pa.int32()),
                        "positions": _lists(order, pa.int32()),
                    }
                )
                made += 1

    return written(docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "postings", group_rows=GROUP_BLOCKS)


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, phrase): the distinct runs of `window` words of each item as term hashes; a shorter item is one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in W.slices(batch.column(1)):
                words = W.tokenize(data, offsets, W.ALNUM_WORDS, lower=True)
                first = W.bounds(words.doc, high - low)
                starts = W.whole(words.doc, window)
                short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < window))
                begin = np.r_[starts, first[short]]
                size = np.r_[np.full(len(starts), window), np.diff(first)[short]]
                each = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
                phrase = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(words.hash[each].view(np.int64)))
                yield pa.record_batch({"item": batch.column(0).take(pa.array(low + words.doc[begin])), "phrase": phrase})

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item string, phrase array<long>").distinct()


def _span(positions: np.ndarray, starts: np.ndarray, i: int) -> np.ndarray:
    return positions[starts[i] : starts[i + 1]]


def _has(sorted_values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a value lies in [low, high], for each pair."""
    return np.searchsorted(sorted_values, low) < np.searchsorted(sorted_values, high, side="right")


def _matches(phrases: np.ndarray, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, first: np.ndarray, slop: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(phrase, first words, ends) of the phrases, all of one length, in a block.

    With slop: places of the rarest term with every other term at most slop words away, in the same document.
    """
    length = phrases.shape[1]
    if not len(terms):
        return
    at = np.minimum(np.searchsorted(terms, phrases), len(terms) - 1)
    present = np.flatnonzero((terms[at] == phrases).all(axis=1))
    order = np.argsort(np.diff(starts)[at[present]], axis=1, kind="stable")
    for row, rank in zip(present, order, strict=True):
        place = _span(positions, starts, at[row, rank[0]]).astype(np.int64)
        doc = np.searchsorted(first, place, side="right") - 1
        if slop is None:
            low = place - rank[0]
            inside = (low >= first[doc]) & (low + length <= first[doc + 1])
            low, high = low[inside], low[inside] + length
        else:
            low, high = np.maximum(first[doc], place - slop), np.minimum(first[doc + 1], place + slop + 1)
        for j in rank[1:]:
            if not len(low):
                break
            other = _span(positions, starts, at[row, j])
            stay = _has(other, low + j, low + j) if slop is None else _has(other, low, high - 1)
            low, high = low[stay], high[stay]
        if len(low):
            yield row, low, high


HITS = "array<struct<phrase:long,low:int,high:int>>"


def search(index: DataFrame, phrases: DataFrame, slop: int | None = None, phrase_words: int = PHRASE_WORDS) -> DataFrame:
    """block, doc, doc_id, n_words, hits (array of phrase, low, high: the phrase's hash, words from 0, end exclusive), for each document of the index.

    phrases: (phrase).  Exact phrases, or with slop all words of a phrase within slop words of its rarest; each place
    of a phrase is one hit, whatever items have it.
    Phrases go to the executors in groups of about phrase_words words, by hash: more phrases make more groups.
    """
    spark = index.sparkSession
    phrases = written(spark, phrases.select("phrase").distinct().withColumn("id", F.xxhash64("phrase")), "phrases")
    total = phrases.agg(F.coalesce(F.sum(F.size("phrase")), F.lit(0))).first()[0]
    groups = max(1, -(-total // phrase_words))
    found = None
    for i in range(groups):
        part = phrases.where(F.pmod("id", F.lit(groups)) == i).toArrow()
        ids = part.column("id").to_numpy()
        sizes = part.column("phrase").combine_chunks().value_lengths().to_numpy().astype(np.int64)
        flat = part.column("phrase").combine_chunks().flatten().to_numpy().view(np.uint64) if len(ids) else np.zeros(0, np.uint64)
        begin = np.cumsum(sizes) - sizes
        kinds = [(ids[sizes == n], flat[begin[sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)]
        sent = spark.sparkContext.broadcast(kinds)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(len(batch)):
                    ids, first, terms, starts, positions = (batch.column(i)[r].values for i in range(1, 6))
                    first, starts, positions = (x.to_numpy().astype(np.int64) for x in (first, starts, positions))
                    terms = terms.to_numpy().view(np.uint64)
                    hits = [(np.full(len(low), names[row]), low, high) for names, words in sent.value for row, low, high in _matches(words, terms, starts, positions, first, slop)]
                    phrase, low, high = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 3
                    doc = np.searchsorted(first, low, side="right") - 1
                    order = np.lexsort((phrase, high, low))  # documents follow each other in a block
                    doc, phrase, low, high = (x[order] for x in (doc, phrase, low, high))
                    places = pa.StructArray.from_arrays([pa.array(phrase), pa.array(low - first[doc], pa.int32()), pa.array(high - first[doc], pa.int32())], ["phrase", "low", "high"])
                    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)), pa.int32()), places)
                    yield pa.record_batch({"block": pa.array([batch.column(0)[r].as_py()] * len(ids), pa.string()), "doc": pa.array(range(len(ids)), pa.int32()), "doc_id": ids, "n_words": pa.array(np.diff(first), pa.int64()), "hits": lists})

        got = index.mapInArrow(run, f"block string, doc int, doc_id long, n_words long, hits {HITS}")
        found = got if found is None else found.union(got)
    if groups > 1:
        found = found.groupBy("block", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))
    return found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), items (ids, sorted as strings, comma-joined), n_items, for each row of docs."""
    spark = docs.sparkSession
    phrases = written(spark, windows(items, window), "windows")
    # Occurrences in order; each adds what it covers beyond the ones before.
    covered = F.aggregate(
        F.array_sort(F.transform("hits", lambda x: F.struct(x.low.alias("low"), x.high.alias("high")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s.end, x.high).alias("end"), (s.n + F.greatest(F.lit(0), x.high - F.greatest(s.end, x.low))).cast("long").alias("n")),
        lambda s: s.n,
    )
    found = search(build_index(docs), phrases).select("block", "doc", "doc_id", "n_words", covered.alias("n_hit"), F.array_distinct(F.transform("hits", lambda x: x["phrase"])).alias("phrases"))
    found = written(spark, found, "found")
    # A phrase can be of many items, and a phrase of many documents: both are joined, not gathered.
    met = found.where(F.size("phrases") > 0).select("block", "doc", F.explode("phrases").alias("id"))
    named = salted_join(met, phrases.where("item IS NOT NULL").select(F.xxhash64("phrase").alias("id"), "item"), ["id"]).select("block", "doc", "item").distinct()
    listed = named.groupBy("block", "doc").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    out = found.join(listed, ["block", "doc"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("items"))


def keep_clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of docs, with all their columns, whose doc_id has no hit in the result of decontaminate()."""
    return without(docs, found.where("n_hit > 0").select("doc_id"))

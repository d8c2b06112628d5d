"""Ranked lexical search: MaxScore over the shards of an inverted index.

The index is a written table with a row for each shard, a block of documents: posting lists of all
terms of its whole texts (places of the documents in the shard, occurrences), and for each list the
most occurrences and the shortest document, from which an upper bound of the term's part in any
score follows.  Statistics of the collection are sums over all shards.

Each shard answers each item by MaxScore.  The item's lists are put in order of their bounds; the
longest run of the least ones that together stay below the tenth best score so far is non-essential.
Documents are met in stretches, through the essential lists alone; non-essential lists are probed,
greatest bound first, only for documents that can still qualify: whose score so far and the bounds of
the lists left reach that score.  A document that could tie is never dropped.  As the tenth score
rises, the split moves.  A shard gives ten documents an item at most, so that the last ranking sorts
few rows.  Items are sent to the shards in groups of bounded size.

Terms are [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z lower-cased.  Null and empty texts have
none.  Repeated documents are documents of their own, and rows without doc_id come last among equal
scores.  Items alike in item_id and text are one item; other rows are items of their own, a null
item_id too.  Without documents or items there are no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.llm import words as W
from vitalspark.llm.common import small_batches, written

TOP = 10
#: Share of the document length in a score, in hundredths.
LENGTH_SHARE = 75
#: Bytes of text in a shard; shards in a row group of the index; documents in a stretch; terms of items that are sent to the shards at once (16 bytes each).
SHARD_BYTES, GROUP_SHARDS, STRETCH, ITEM_TERMS = 1 << 22, 1, 512, 2_000_000

SHARD = "doc_ids array<long>, lengths array<int>, n_docs long, n_words long, terms array<long>, starts array<int>, most array<int>, shortest array<int>, docs array<int>, times array<int>"


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """SHARD rows over every word of every text, written in the shared folder.

    docs[starts[i]:starts[i+1]] are the documents with terms[i], by their places in the shard, and times how often
    they have it; most and shortest are a list's most occurrences and the words of its shortest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, _, _ in W.slices(batch.column(1), shard_bytes):
                hashes, of = W.word_hashes(batch.column(1).slice(low, high - low), W.ALNUM_WORDS, lower=True)
                lengths = np.diff(W.bounds(of, high - low))
                terms, which = np.unique(hashes, return_inverse=True)
                each, times = np.unique(which * (high - low) + of, return_counts=True)
                term, doc = np.divmod(each, high - low)
                starts = np.searchsorted(term, np.arange(len(terms) + 1))
                bounds = starts[:-1]
                yield pa.record_batch(
                    {
                        "doc_ids": pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), batch.column(0).slice(low, high - low)),
                        "lengths": _lists(lengths, pa.int32()),
                        "n_docs": pa.array([int((lengths > 0).sum())]),
                        "n_words": pa.array([int(lengths.sum())]),
                        "terms": _lists(terms.view(np.int64), pa.int64()),
                        "starts": _lists(starts, pa.int32()),
                        "most": _lists(np.maximum.reduceat(times, bounds) if len(terms) else bounds, pa.int32()),
                        "shortest": _lists(np.minimum.reduceat(lengths[doc], bounds) if len(terms) else bounds, pa.int32()),
                        "docs": _lists(doc, pa.int32()),
                        "times": _lists(times, pa.int32()),
                    }
                )

    small_batches(docs.sparkSession)
    return written(docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SHARD), "shards", group_rows=GROUP_SHARDS)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms, repeats): the distinct terms of each item and how often it has them; item numbers the rows that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in W.slices(batch.column(2)):
                words = W.tokenize(data, offsets, W.ALNUM_WORDS, lower=True)
                first = W.bounds(words.doc, high - low)
                for i in range(high - low):
                    terms, repeats = np.unique(words.hash[first[i] : first[i + 1]], return_counts=True)
                    if len(terms):
                        yield pa.record_batch({"item": batch.column(0).slice(low + i, 1), "item_id": batch.column(1).slice(low + i, 1), "terms": _lists(terms.view(np.int64), pa.int64()), "repeats": _lists(repeats, pa.int64())})

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").distinct().select(F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("item"), "item_id", "text")
    return rows.mapInArrow(run, f"item long, item_id {kind}, terms array<long>, repeats array<long>")


def length_factor(lengths: np.ndarray, docs: int, words: int) -> np.ndarray:
    """A document's m: what its length adds to the occurrences that halve a term's effect."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths.astype(np.int64) * docs) // max(1, words)


def effect(times: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """What a term's occurrences count in a document, in millionths: grows with them, falls with the factor."""
    times = times.astype(np.int64)
    return (1_000_000_000 * times) // (1000 * times + 8 * factor)


class Lists(NamedTuple):
    """An item's posting lists in a shard, least upper bound first: bounds, their running sums, factors (weight x repeats), and for each its documents and occurrences."""

    bounds: np.ndarray
    sums: np.ndarray
    factors: list[int]
    docs: list[np.ndarray]
    times: list[np.ndarray]


def best(lists: Lists, factor: np.ndarray, ids: np.ndarray, top: int = TOP, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and places of the `top` best documents of a shard by MaxScore, equal ones by ids; and how many postings were read.

    factor: each document's length factor.
    """
    scores, places, least, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0
    cuts = np.arange(0, len(factor) + stretch, stretch)
    borders = [np.searchsorted(x, cuts) for x in lists.docs]
    n = len(lists.docs)
    for k in range(len(cuts) - 1):
        split = int(np.searchsorted(lists.sums, least))  # lists before it can't reach `least` together
        if split == n:
            break
        total, met = np.zeros(stretch, np.int64), np.zeros(stretch, bool)
        for i in range(split, n):
            low, high = borders[i][k], borders[i][k + 1]
            if low < high:
                at = lists.docs[i][low:high]
                total[at - cuts[k]] += lists.factors[i] * effect(lists.times[i][low:high], factor[at])
                met[at - cuts[k]] = True
                read += high - low
        found = np.flatnonzero(met)
        for i in range(split - 1, -1, -1):
            found = found[total[found] + lists.sums[i] >= least]
            low, high = borders[i][k], borders[i][k + 1]
            if not len(found) or low == high:
                continue
            own = lists.docs[i][low:high]
            at = np.minimum(np.searchsorted(own, found + cuts[k]), len(own) - 1)
            hit = own[at] == found + cuts[k]
            total[found[hit]] += lists.factors[i] * effect(lists.times[i][low:high][at[hit]], factor[found[hit] + cuts[k]])
            read += len(found)
        found = found[total[found] >= least]
        if len(found):
            scores, places = np.r_[scores, total[found]], np.r_[places, found + cuts[k]]
            order = np.lexsort((ids[places], -scores))[:top]
            scores, places = scores[order], places[order]
            if len(scores) == top:
                least = int(scores[-1])
    return scores, places, read


def _array(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def search(index: DataFrame, items: DataFrame, top: int = TOP, group_terms: int = ITEM_TERMS) -> DataFrame:
    """item, item_id, doc_id, score: the `top` best documents of each shard for each item; items as of item_terms(), whose terms are sent to the shards in groups of about group_terms."""
    spark = index.sparkSession
    items = written(spark, items, "items")
    docs, words, terms = (x or 0 for x in (*index.agg(F.sum("n_docs"), F.sum("n_words")).first(), items.agg(F.sum(F.size("terms"))).first()[0]))
    groups = max(1, -(-terms // group_terms))
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for g in range(groups):
        part = items.where(F.pmod("item", F.lit(groups)) == g).select("item", "terms", "repeats").toArrow().combine_chunks()
        sizes = part.column("terms").combine_chunks().value_lengths().to_numpy() if len(part) else np.zeros(0, np.int64)
        flat, repeats = ((part.column(c).combine_chunks().flatten().to_numpy() if len(part) else np.zeros(0, np.int64)) for c in ("terms", "repeats"))
        vocabulary, which = np.unique(flat.view(np.uint64), return_inverse=True)
        found = spark.sparkContext.broadcast(vocabulary)

        def frequency(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(found.value), np.int64)
            for batch in batches:
                for r in range(len(batch)):
                    terms, starts = _array(batch, "terms", r).view(np.uint64), _array(batch, "starts", r)
                    if len(terms):
                        at = np.minimum(np.searchsorted(terms, found.value), len(terms) - 1)
                        total += np.where(terms[at] == found.value, np.diff(starts)[at], 0)
            some = np.flatnonzero(total)
            yield pa.record_batch({"term": pa.array(some, pa.int32()), "df": pa.array(total[some])})

        counted = index.select("terms", "starts").mapInArrow(frequency, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(vocabulary), np.int64)
        df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        begins = np.r_[0, np.cumsum(sizes)]
        sent = spark.sparkContext.broadcast((part.column("item").to_numpy(), begins, which, repeats * weight[which] if len(which) else repeats, vocabulary))

        def answer(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, begins, which, factors, vocabulary = sent.value
            for batch in batches:
                for r in range(len(batch)):
                    terms, starts, most, shortest, own_docs, own_times, lengths = (_array(batch, c, r) for c in ("terms", "starts", "most", "shortest", "docs", "times", "lengths"))
                    if not len(terms):
                        continue
                    ids = _ids(batch.column("doc_ids")[r].values)
                    factor = length_factor(lengths, docs, words)
                    at = np.minimum(np.searchsorted(terms.view(np.uint64), vocabulary), len(terms) - 1)
                    place = np.where(terms.view(np.uint64)[at] == vocabulary, at, -1)
                    limit = np.where(place >= 0, effect(most[at], length_factor(shortest[at], docs, words)), 0)
                    got = []
                    for i in range(len(names)):
                        mine = slice(begins[i], begins[i + 1])
                        bounds = factors[mine] * limit[which[mine]]
                        order = np.argsort(bounds, kind="stable")
                        order = order[bounds[order] > 0]
                        if len(order):
                            spans = [(starts[p], starts[p + 1]) for p in place[which[mine]][order].tolist()]
                            lists = Lists(bounds[order], np.cumsum(bounds[order]), factors[mine][order].tolist(), [own_docs[a:b] for a, b in spans], [own_times[a:b] for a, b in spans])
                            scores, places, _ = best(lists, factor, ids, top)
                            got.append((np.full(len(scores), names[i]), places, scores))
                    if got:
                        item, places, scores = (np.concatenate(x) for x in zip(*got, strict=True))
                        yield pa.record_batch({"item": pa.array(item), "doc_id": batch.column("doc_ids")[r].values.take(pa.array(places)), "score": pa.array(scores)})

        rows = index.mapInArrow(answer, "item long, doc_id long, score long")
        out = rows if out is None else out.union(rows)
    return out.join(items.select("item", "item_id"), "item").select("item", F.col("item_id").cast(kind).alias("item_id"), "doc_id", "score")


def _ids(values: pa.Array) -> np.ndarray:
    """doc_ids for sorting: null ones last."""
    return values.fill_null(np.iinfo(np.int64).max).to_numpy()


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of the highest scores above 0 for each item, equal ones by ascending doc_id."""
    found = search(build_index(docs, shard_bytes), item_terms(items), top)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")

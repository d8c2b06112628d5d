"""Source divergence audit: how far the terms of each source of a language stray from the others'.

Each partition counts terms in byte tries: kept flat, in preorder, which is the order of the terms'
UTF-8 bytes, with counters by source at the leaves.  A trie that has grown to its bound is handed
on, leaf by leaf, and a new one begins, so that memory doesn't grow with the partition.  The tries are
merged by prefix range: leaves are dealt by ranges of (lang, term), sorted, and a range is walked
once, adding up the counters of each term as they stream by; no term is gathered, however many
tries hold it.  The walk over the kept terms, again in UTF-8 order, adds up the values of the pairs
of sources and holds the best terms of each source, equal values by term.

All arithmetic is on integers and exact: a scaled share is made by long division, digit by digit.
Terms are [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z lower-cased.  Null text, lang and source count as
empty.  Repeated rows are documents of their own.  Sources without terms, and languages without a kept
term, have their pairs (value 0 if no term is kept).  Without documents there are no rows.  Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.llm import words as W
from vitalspark.llm.common import partitions, small_batches, written
from vitalspark.llm.graph import joined

#: Documents of a language that a term must be in; terms that are reported for a source.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Bytes of text counted at once; counters a trie holds before it is handed on; cells (terms x sources) of the walk at once, and of the sums of pairs that a task holds.
TEXT_BYTES, TRIE_COUNTERS, CELLS = 1 << 21, 600_000, 1 << 20
SCALE_DIGITS = 3  # of 1000 each: shares are in units of 1 / 10^9

LEAVES = "lang string, term binary, docs long, sources array<int>, counts array<long>"


class Trie(NamedTuple):
    """A byte trie in preorder: distinct terms in UTF-8 order, and counters (leaf, group, count, docs) in the order of (leaf, group)."""

    terms: pa.Array
    leaf: np.ndarray
    group: np.ndarray
    count: np.ndarray
    docs: np.ndarray


def _summed(leaf: np.ndarray, group: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Values added up for each (leaf, group), in that order."""
    if not len(leaf):
        return leaf, group, values
    order = np.lexsort((group, leaf))
    leaf, group = leaf[order], group[order]
    begins = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (group[1:] != group[:-1])])
    return leaf[begins], group[begins], [np.add.reduceat(v[order], begins) for v in values]


def count(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> Trie:
    """The trie of some documents' terms; groups: the counter that each document counts in."""
    start, end = W.spans(data, offsets, W.LETTER_WORDS)
    doc = np.searchsorted(offsets, start, side="right") - 1
    places = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    flat = W.lowered(data[W.LETTER_WORDS[data]])
    met = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(flat)]).dictionary_encode()
    order = pc.sort_indices(met.dictionary).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    each, times = np.unique(doc * max(1, len(order)) + rank[met.indices.to_numpy()], return_counts=True)
    doc, leaf = np.divmod(each, max(1, len(order)))
    leaf, group, (counts, docs) = _summed(leaf, groups[doc], [times.astype(np.int64), np.ones(len(times), np.int64)])
    return Trie(met.dictionary.take(pa.array(order)), leaf, group, counts, docs)


def merge(tries: list[Trie]) -> Trie:
    """One trie with the counters of all, those of equal terms added up."""
    met = pa.concat_arrays([t.terms for t in tries]).dictionary_encode()
    order = pc.sort_indices(met.dictionary).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank, first = rank[met.indices.to_numpy()], np.cumsum([0] + [len(t.terms) for t in tries])
    leaf = np.concatenate([rank[t.leaf + at] for t, at in zip(tries, first, strict=False)])
    group, counts, docs = (np.concatenate([t[i] for t in tries]) for i in (2, 3, 4))
    leaf, group, (counts, docs) = _summed(leaf, group, [counts, docs])
    return Trie(met.dictionary.take(pa.array(order)), leaf, group, counts, docs)


def _lists(begins: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[begins, len(values)], pa.int32()), pa.array(values, kind))


def _leaves(trie: Trie, langs: list[str], sources: list[int]) -> pa.RecordBatch:
    """Rows of LEAVES: a trie cut by language, each leaf with its counters by source; langs and sources are those of the groups."""
    names = sorted(set(langs))
    lang = np.array([names.index(x) for x in langs], np.int64)[trie.group]
    source = np.array(sources, np.int64)[trie.group]
    order = np.lexsort((source, trie.leaf, lang))
    lang, leaf = lang[order], trie.leaf[order]
    begins = np.flatnonzero(np.r_[np.full(min(1, len(leaf)), True), (lang[1:] != lang[:-1]) | (leaf[1:] != leaf[:-1])])
    return pa.record_batch(
        {
            "lang": pa.array(names, pa.string()).take(pa.array(lang[begins])),
            "term": trie.terms.take(pa.array(leaf[begins])),
            "docs": pa.array(np.add.reduceat(trie.docs[order], begins) if len(begins) else begins),
            "sources": _lists(begins, source[order], pa.int32()),
            "counts": _lists(begins, trie.count[order], pa.int64()),
        }
    )


def tries(docs: DataFrame) -> DataFrame:
    """LEAVES of each partition's tries; docs: (lang, code, text), code an int for each source of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, int], int] = {}
        parts: list[Trie] = []
        for batch in batches:
            own = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            for low, high, data, offsets in W.slices(batch.column(2), TEXT_BYTES):
                parts.append(count(data, offsets, own[low:high]))
                if sum(len(t.leaf) for t in parts) > TRIE_COUNTERS:
                    parts = [merge(parts)]
                    if len(parts[0].leaf) > TRIE_COUNTERS // 2:
                        yield _leaves(parts.pop(), *map(list, zip(*groups, strict=True)))
        if parts:
            yield _leaves(merge(parts), *map(list, zip(*groups, strict=True)))

    return docs.select("lang", "code", "text").mapInArrow(run, LEAVES)


def _walked(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Sorted LEAVES with those of a term made one: all terms but the last, and the last, which may go on."""
    lang, term = (rows.column(i).combine_chunks() for i in (0, 1))
    n = len(lang)
    same = np.ones(n, bool)
    same[0] = False
    for x in (lang, term):
        same[1:] &= pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(~same)
    of = np.cumsum(~same) - 1
    sources, counts = (rows.column(i).combine_chunks() for i in (3, 4))
    each = np.repeat(of, sources.value_lengths().to_numpy())
    each, source, (total,) = _summed(each, sources.flatten().to_numpy(), [counts.flatten().to_numpy()])
    firsts = np.searchsorted(each, np.arange(len(begins)))
    docs = np.add.reduceat(rows.column(2).to_numpy(), begins)
    at = pa.array(begins)
    out = pa.table([lang.take(at), term.take(at), pa.array(docs), _lists(firsts, source, pa.int32()), _lists(firsts, total, pa.int64())], names=rows.column_names).cast(rows.schema)
    return out.slice(0, len(out) - 1), out.slice(len(out) - 1)


def merged(leaves: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """LEAVES of one trie over all, of the terms in least_docs documents of their language or more.  leaves: a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if len(batch):
                rows = pa.Table.from_batches([batch])
                done, last = _walked(rows if last is None else pa.concat_tables([last, rows]))
                yield from done.filter(pc.greater_equal(done.column(2), least_docs)).to_batches()
        if last is not None:
            yield from last.filter(pc.greater_equal(last.column(2), least_docs)).to_batches()

    return leaves.repartitionByRange(partitions(leaves.sparkSession), "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, LEAVES)


def share(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + kept)), exact for counts below 9 x 10^15."""
    rest, whole, out = counts + 1, np.asarray(total) + kept, 0
    out, rest = np.divmod(rest, whole)
    for _ in range(SCALE_DIGITS):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _best(held: tuple[np.ndarray, pa.Array] | None, values: np.ndarray, terms: pa.Array, top: int) -> tuple[np.ndarray, pa.Array]:
    """The `top` greatest values and their terms, equal ones by term, of those held and new ones."""
    if held is not None:
        values, terms = np.r_[held[0], values], pa.concat_arrays([held[1], terms])
    order = pc.sort_indices(pa.table([pa.array(values), terms], names=["v", "t"]), sort_keys=[("v", "descending"), ("t", "ascending")])[:top]
    return values[order.to_numpy()], terms.take(order)


FOUND = "lang string, part string, code int, other int, term binary, value long"


def _walk(kept: DataFrame, sizes: dict[str, tuple[int, np.ndarray]], top: int) -> DataFrame:
    """FOUND rows: sums of pairs, and candidates for each source's best terms, of each task.  sizes: kept terms of a language, and its sources' counts."""
    sent = kept.sparkSession.sparkContext.broadcast(sizes)

    def pairs(lang: str, sums: np.ndarray, first: int = 0) -> pa.RecordBatch:
        rows, width = sums.shape
        n = rows * width
        return pa.record_batch([pa.array([lang] * n, pa.string()), pa.array(["pair"] * n, pa.string()), pa.array(first + np.arange(n) // width, pa.int32()), pa.array(np.arange(n) % width, pa.int32()), pa.nulls(n, pa.binary()), pa.array(sums.ravel())], names=[x.split()[0] for x in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], tuple[np.ndarray, pa.Array]] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for which, lang in enumerate(langs.dictionary.to_pylist()):
                rows = batch.filter(pc.equal(langs.indices, which))
                kept_terms, totals = sent.value[lang]
                width = len(totals)
                step = max(1, CELLS // width)
                for low in range(0, len(rows), step):
                    part = rows.slice(low, step)
                    terms, sources = part.column(1), part.column(3)
                    counts = np.zeros((len(part), width), np.int64)
                    counts[np.repeat(np.arange(len(part)), sources.value_lengths().to_numpy()), sources.flatten().to_numpy()] = part.column(4).flatten().to_numpy()
                    p, q = share(counts, totals, kept_terms), share(counts.sum(axis=1), int(totals.sum()), kept_terms)
                    for a in range(width):
                        off = p[:, a : a + 1] - p
                        row = (off * off // p).sum(axis=0)
                        if width * width > CELLS:
                            yield pairs(lang, row[None], a)
                            continue
                        if lang not in sums:
                            if sum(x.size for x in sums.values()) > CELLS:
                                yield from (pairs(k, x) for k, x in sums.items())
                                sums = {}
                            sums[lang] = np.zeros((width, width), np.int64)
                        sums[lang][a] += row
                    over = np.where((counts > 0) & (p > q[:, None]), (p - q[:, None]) ** 2 // q[:, None], -1)
                    for a in range(width):
                        held = best.get((lang, a))
                        least = held[0][-1] if held is not None and len(held[0]) == top else 0
                        at = np.flatnonzero(over[:, a] >= least)
                        if len(at):
                            best[lang, a] = _best(held, over[at, a], terms.take(pa.array(at)), top)
        yield from (pairs(k, x) for k, x in sums.items())
        for (lang, a), (values, terms) in best.items():
            n = len(values)
            yield pa.record_batch([pa.array([lang] * n, pa.string()), pa.array(["term"] * n, pa.string()), pa.array(np.full(n, a), pa.int32()), pa.nulls(n, pa.int32()), terms, pa.array(values)], names=[x.split()[0] for x in FOUND.split(", ")])

    return kept.mapInArrow(run, FOUND)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source the distance of each other source of its language ('pair'), and the terms in which it exceeds its language ('term').

    The table of sources is sent to the tasks, and held by the driver: its square is the number of pairs in the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = docs.select("lang", "source").distinct().withColumn("code", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))
    groups = written(spark, groups, "sources")
    leaves = written(spark, tries(joined(docs, groups, ["lang", "source"], groups.count())), "leaves")
    kept = written(spark, merged(leaves, least_docs), "kept")
    found = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("code")).agg(F.sum("x.counts").alias("n"))
    terms = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    totals: dict[str, list[int]] = {}
    for r in groups.join(found, ["lang", "code"], "left").orderBy("lang", "code").toLocalIterator():
        totals.setdefault(r["lang"], []).append(r["n"] or 0)
    walked = written(spark, _walk(kept, {k: (terms[k], np.array(v, np.int64)) for k, v in totals.items() if k in terms}, top), "walked")

    names = groups.select("lang", "code", "source")
    others = groups.select("lang", F.col("code").alias("other"), F.col("source").alias("item"))
    summed = walked.where("part = 'pair' AND code <> other").groupBy("lang", "code", "other").agg(F.sum("value").alias("value"))
    # The result has every pair of sources of a language, whatever they share.
    pair = names.join(others, "lang").where("code <> other").join(summed, ["lang", "code", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    term = walked.where("part = 'term'").join(names, ["lang", "code"]).select("lang", "source", "part", F.col("term").cast("string").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pair, term)]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")

"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

An anchor is one of ANCHORS.  Its signature is the anchor and the next CHAIN content words (words
that are no anchors) after it.  A text's fingerprint is the set of its signatures as 32-bit hashes; a
text without any has the set of its words instead, so that each text can be compared.  Likeness is
the Jaccard of two sets.  For a search sets are partitioned by their size: sizes whose ratio is
under the wanted likeness can't reach it, and only neighbouring partitions meet.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased.  Null texts count as empty; two
empty sets are alike (1), an empty and another are not (0).  Documents are ordered by
doc_id, rows alike in it by text, rows without it first.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspark.llm import words as W
from vitalspark.llm.common import partitions, written
from vitalspark.llm.graph import salted_join

#: Common words of four languages.
ANCHORS = "a an and are as at by de der des die das dem den ein el en et für ist il in is it la las le les los mit of on que se the to un une und was with".split()
CHAIN, LENGTH_CLASS = 2, 1.25

_ANCHOR_HASHES: list[np.ndarray] = []


def _anchors() -> np.ndarray:
    if not _ANCHOR_HASHES:
        data = " ".join(ANCHORS).encode()
        _ANCHOR_HASHES.append(np.sort(W.tokenize(np.frombuffer(data, np.uint8), np.array([0, len(data)]), W.ALNUM_WORDS, lower=True).hash))
    return _ANCHOR_HASHES[0]


def signatures(texts: pa.Array, chain: int = CHAIN) -> Iterator[np.ndarray]:
    """The sorted distinct 32-bit signature hashes of each text."""
    for low, high, data, offsets in W.slices(texts):
        words = W.tokenize(data, offsets, W.ALNUM_WORDS, lower=True)
        anchor = np.isin(words.hash, _anchors())
        content, spots = np.flatnonzero(~anchor), np.flatnonzero(anchor)
        after = np.searchsorted(content, spots)
        enough = after + chain <= len(content)
        spots, after = spots[enough], after[enough]
        same = words.doc[spots] == words.doc[content[after + chain - 1]]
        spots, after = spots[same], after[same]
        h = words.hash[spots]
        for i in range(chain):
            h = W.mix(h * np.uint64(0x9E3779B97F4A7C15) + words.hash[content[after + i]])
        first, all_first = W.bounds(words.doc[spots], high - low), W.bounds(words.doc, high - low)
        for i in range(high - low):
            own = h[first[i] : first[i + 1]]
            yield np.unique(((own if len(own) else words.hash[all_first[i] : all_first[i + 1]]) >> np.uint64(32)).astype("<u4"))


def size_class(size: int) -> int:
    """Partition of a set's size: geometric steps of LENGTH_CLASS; 0 for an empty set."""
    return 0 if not size else 1 + int(np.floor(np.log(size) / np.log(LENGTH_CLASS)))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 without a comparison if their sizes keep it under `least`."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (n + m - same)


def fingerprint(found: np.ndarray) -> str:
    """The set as text: size partition, colon, base64 of its hashes in order."""
    return f"{size_class(len(found))}:{base64.b64encode(found.tobytes()).decode()}"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "fingerprint": pa.array([fingerprint(x) for x in signatures(batch.column(1))], pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def similar(found: DataFrame, least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, fp) and pairs (left, right, likeness) of different fingerprints with a likeness of `least` or more.

    Equal fingerprints are one class, named by its hash.  Pairs meet in a partition of sizes, or in two
    neighbouring ones, on one of the rarest signatures of each: of a set of n any that is alike enough
    has one of the n - ceil(least * n) + 1 rarest.
    """
    spark = found.sparkSession
    members = found.select("doc_id", F.xxhash64("fingerprint").alias("fp"), "fingerprint")
    sets = members.groupBy("fp").agg(F.min("fingerprint").alias("fingerprint"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(base64.b64decode(x.partition(":")[2]), "<u4").astype(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"fp": batch.column(0), "s": pa.array(values, pa.list_(pa.int64()))})

    sets = written(spark, sets.mapInArrow(unpack, "fp long, s array<long>").where(F.size("s") > 0), "sets")
    one = sets.select("fp", F.size("s").alias("n"), F.explode("s").alias("x"))
    rare = salted_join(one, one.groupBy("x").agg(F.count("*").alias("df")), ["x"])
    order = Window.partitionBy("fp").orderBy("df", "x")
    prefix = rare.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    part = F.floor(F.log("n") / np.log(1 / least)).cast("int")
    prefix = prefix.where("df > 1").select("fp", "n", "x", part.alias("part"))
    right = prefix.select(F.col("fp").alias("right"), F.col("n").alias("m"), "x", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    near = prefix.join(right, ["x", "part"]).where((F.col("fp") != F.col("right")) & (F.col("n") <= F.col("m")) & (F.col("n") >= F.col("m") * least) & ((F.col("n") < F.col("m")) | (F.col("fp") < F.col("right"))))
    near = near.select(F.col("fp").alias("left"), "right").distinct()
    both = near.join(sets.select(F.col("fp").alias("left"), F.col("s").alias("a")), "left").join(sets.select(F.col("fp").alias("right"), F.col("s").alias("b")), "right")
    same = F.size(F.array_intersect("a", "b"))
    pairs = both.select("left", "right", (same / (F.size("a") + F.size("b") - same)).alias("likeness")).where(F.col("likeness") >= least)
    return members.select("doc_id", "fp"), pairs


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, extra, doc_id, text: the rows dealt to ranges of doc_id, each range sorted and followed by the first row of the next range.

    After the last range comes the first row of all.  The ranges' cuts and first ids, one for each range, go through the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("o", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = 4 * partitions(spark)
    cuts = np.unique(np.array(docs.approxQuantile("o", [i / n for i in range(1, n)], 0.25 / n), np.int64))

    @F.pandas_udf("int")
    def bucket(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, o.to_numpy(), side="right").astype(np.int32))

    firsts = sorted((r[0], r[1]) for r in docs.select(bucket("o").alias("bucket"), "o").groupBy("bucket").agg(F.min("o")).collect())
    rows = docs.select(bucket("o").alias("bucket"), F.lit(False).alias("extra"), "doc_id", "o", "text")
    if not firsts:
        return rows.drop("o")
    # One row for each range: its first id, and the range that this row also ends.
    ends = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "o long, bucket int")
    extra = docs.join(F.broadcast(ends), "o").groupBy("bucket", "o").agg(F.min("text").alias("text")).select("bucket", F.lit(True).alias("extra"), F.lit(None).cast("long").alias("doc_id"), "o", "text")
    return rows.union(extra).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "extra", "o", "text").drop("o")


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next row's text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[tuple] = []
        for batch in batches:
            for low in range(0, len(batch), 300):
                rows = carry + list(zip(*(x.to_pylist() for x in batch.slice(low, 300).columns), strict=True))
                carry = rows[-1:]
                texts = [x[3] for x in rows]
                own = list(signatures(pa.array(texts, pa.string())))
                pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in pairs]
                changed = list(signatures(pa.array(edited, pa.string())))
                yield pa.record_batch(
                    {
                        "doc_id": pa.array([rows[i][2] for i in pairs], pa.int64()),
                        "n_chars": pa.array([len(texts[i]) for i in pairs], pa.int64()),
                        "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                        "fingerprint": pa.array([fingerprint(own[i]) for i in pairs], pa.string()),
                        "edited_fingerprint": pa.array([fingerprint(x) for x in changed], pa.string()),
                        "near_edited": pa.array([likeness(own[i], x) for i, x in zip(pairs, changed, strict=True)], pa.float64()),
                        "near_next": pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
                    }
                )

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

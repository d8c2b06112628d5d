"""MinHash near-deduplication with an LSH forest, confirmed on the full shingle sets.

Documents with equal shingle sets are one class; the rest is about classes.  A class has `SLOTS`
minhashes.  The forest has `ORDERS` orders of the slots, each starting elsewhere.  In an order the
classes that share a prefix of the signature form a region; the depth adapts to the region: where
more than `REGION` classes share a prefix, it is lengthened, where fewer do, it is not.  Inside a
region the candidates are a spanning tree of the most alike signatures, and in a crowded one all
its classes against the centre of its densest part, so that the number of candidates stays in
proportion to the classes.  Each class first confirms its likeliest candidate on the full sets;
then come the other candidates between the components found so far.  What is left of regions that
still hold several components - the classes whose signatures allow a link with another component,
and all classes of crowded regions, which may have met their centre only - is joined on its rarest
shingles (prefix filter), which misses no pair.  Confirmed links only make components.

Words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; the set is the distinct 5-word shingles, with
fewer words the whole sequence as one.  Null and empty texts have an empty set and no links.  Rows
with one doc_id are one node.  A row without doc_id takes no part: it has no component and is kept.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm import words as W
from vitalspark.llm.common import BROADCAST_IDS, partitions, scratch, small_batches, written
from vitalspark.llm.graph import extend, joined, salted_join

SHINGLE, PERCENT = 5, 75
SLOTS, ORDERS, DEPTHS, REGION = 128, 16, (2, 4, 8, 16, 32, 64), 256
#: Signatures this much under the wanted similarity still make a candidate: over 3.5 standard deviations.
SLACK = 0.14
#: Groups that the partners of one document are dealt over, and bits of a shingle's slot among the counts that order shingles.
GROUPS, SKETCH = 16, 21

_random = np.random.default_rng(5)
_XOR = _random.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
_MUL = _random.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the sorted distinct shingle hashes of each row) for slices of the texts."""
    for low, high, data, offsets in W.slices(texts):
        words = W.tokenize(data, offsets, W.SPACE_WORDS, lower=True)
        first, sums = W.bounds(words.doc, high - low), W.prefix_sums(words.hash)
        count = np.diff(first)
        size = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
        begin = np.repeat(first[:-1] - np.cumsum(size) + size, size) + np.arange(size.sum())
        hashes = W.span_hash(sums, begin, begin + np.repeat(np.minimum(count, shingle), size))
        yield low, [np.unique(x) for x in np.split(hashes, np.cumsum(size)[:-1])]


def signature(hashes: np.ndarray) -> np.ndarray:
    """SLOTS minhashes of a set that isn't empty."""
    top = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(top), 2048):
        np.minimum(out, ((top[i : i + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=out)
    return out


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), sig, low (its slots' lowest bytes; empty for an empty set) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets in shingle_sets(batch.column(1), shingle):
                digests = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)
                signatures = [signature(x) if len(x) else np.zeros(0, np.uint32) for x in sets]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(low, len(sets)),
                        "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                        "d1": pa.array(digests[:, 0]),
                        "d2": pa.array(digests[:, 1]),
                        "sig": pa.array([x.tobytes() for x in signatures], pa.binary()),
                        "low": pa.array([x.astype(np.uint8).tobytes() for x in signatures], pa.binary()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary, low binary")


def _signatures(column: pa.Array, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize * SLOTS
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + width * len(column)].view(kind).reshape(-1, SLOTS)


def _forest(classes: DataFrame) -> DataFrame:
    """rep, o, k: for each class and order, the prefix hash at each depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signatures(batch.column(1), np.uint32).astype(np.uint64)
            for o in range(ORDERS):
                turned = np.roll(sig, -o * (SLOTS // ORDERS), axis=1)
                h, keys = np.full(len(sig), o + 1, np.uint64), []
                for d in range(DEPTHS[-1]):
                    h = W.mix(h * np.uint64(0x100000001B3) + turned[:, d])
                    if d + 1 in DEPTHS:
                        keys.append(h.view(np.int64))
                flat = pa.array(np.stack(keys, axis=1).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * len(DEPTHS), pa.int32()), flat)
                yield pa.record_batch({"rep": batch.column(0), "o": pa.array(np.full(len(sig), o, np.int32)), "k": lists})

    return classes.select("rep", "sig").mapInArrow(run, "rep long, o int, k array<long>")


def _regions(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, rep, top: key of the crowded region around it or null), and (top, rep) of the crowded regions."""
    spark = classes.sparkSession
    # In each order only classes that share the shortest prefix with another one go on.
    keys = _forest(classes).select("rep", "o", F.col("k")[0].alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    active = written(spark, salted_join(_forest(classes).withColumn("key", F.col("k")[0]), keys, ["key"]), "forest")
    done, crowds = active.where(F.col("n") <= REGION).select(F.col("key").alias("region"), "rep", F.lit(None).cast("long").alias("top")), []
    active = active.where(F.col("n") > REGION).select("rep", "o", "k", F.col("key").alias("top"))
    for level in range(1, len(DEPTHS)):
        if not active.limit(1).count():
            break
        crowds.append(active.select("top", "rep"))
        deeper = active.withColumn("key", F.col("k")[level])
        sizes = deeper.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        deeper = written(spark, salted_join(deeper, sizes, ["key"]), "forest")
        done = done.union(deeper.where(F.col("n") <= REGION).select(F.col("key").alias("region"), "rep", "top"))
        active = deeper.where(F.col("n") > REGION).select("rep", "o", "k", F.col("key").alias("top"))
    if crowds and active.limit(1).count():
        # Still crowded at the last depth: parts of a bounded size; their centres tie them together.
        crowds.append(active.select("top", "rep"))
        sizes = active.groupBy("top").agg(F.count("*").alias("n"))
        parts = salted_join(active, sizes, ["top"]).withColumn("region", F.xxhash64("top", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / (REGION // 2)))))
        done = done.union(parts.select("region", "rep", "top"))
    crowd = spark.createDataFrame([], "top long, rep long")
    for x in crowds:
        crowd = crowd.union(x)
    return done, crowd


def _alike(sig: np.ndarray) -> np.ndarray:
    return (sig[:, None, :] == sig[None, :, :]).mean(axis=2)


def _spanning(alike: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the greatest likeness, of at least `least` each."""
    n = len(alike)
    best, parent, free, edges = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool), []
    best[0] = 2
    for _ in range(n):
        i = int(np.argmax(np.where(free, best, -2)))
        free[i] = False
        if least <= best[i] <= 1:
            edges.append((int(parent[i]), i))
        closer = free & (alike[i] > best)
        best[closer], parent[closer] = alike[i][closer], i
    return edges


def _by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole regions (first column, sorted) and where each region begins, with the end."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        whole = pa.concat_batches([*rest, batch]) if rest else batch
        if len(whole):  # the last region may go on in the next batch
            region = whole.column(0).to_numpy()
            cut = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
            if cut[-1]:
                yield whole.slice(0, cut[-1]), cut
            rest = [whole.slice(cut[-1])]
    for whole in rest:
        yield whole, np.array([0, len(whole)])


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "region").sortWithinPartitions("region", "rep")


def _trees(regions: DataFrame, least: float) -> DataFrame:
    """u, v, alike: the spanning trees of the regions; where a region lies in a crowded one (top), also a row (centre, centre) with top, the region's size n and the centre's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cut in _by_region(batches):
            rep, top, sig = part.column(1).to_numpy(), part.column(2), _signatures(part.column(3), np.uint8)
            out: list[tuple] = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a < 2:
                    continue
                alike = _alike(sig[a:b])
                if top[a].is_valid:
                    at = a + int(np.argmax(alike.sum(axis=1)))
                    out.append((int(rep[at]), int(rep[at]), 1.0, top[a].as_py(), int(b - a), sig[at].tobytes()))
                for i, j in _spanning(alike, least):
                    x, y = int(rep[a + i]), int(rep[a + j])
                    if x != y:
                        out.append((min(x, y), max(x, y), float(alike[i, j]), None, None, None))
            if out:
                u, v, s, t, n, c = zip(*out, strict=True)
                yield pa.record_batch(
                    {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "alike": pa.array(s, pa.float64()), "top": pa.array(t, pa.int64()), "n": pa.array(n, pa.int64()), "sig": pa.array(c, pa.binary())}
                )

    return _dealt(regions.select("region", "rep", "top", "sig")).mapInArrow(run, "u long, v long, alike double, top long, n long, sig binary")


def _suspects(rows: DataFrame, least: float) -> DataFrame:
    """rep: the classes that have, in one of their regions, a class of another component `comp` with a signature alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cut in _by_region(batches):
            rep, comp, sig = part.column(1).to_numpy(), part.column(2).to_numpy(), _signatures(part.column(3), np.uint8)
            found = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own = comp[a:b]
                if (own != own[0]).any():
                    found.append(rep[a:b][((_alike(sig[a:b]) >= least) & (own[:, None] != own[None, :])).any(axis=1)])
            if found:
                yield pa.record_batch({"rep": pa.array(np.concatenate(found))})

    return _dealt(rows.select("region", "rep", "comp", "sig")).mapInArrow(run, "rep long").distinct()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets, and something is shared."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same > 0 and 100 * same >= percent * (len(a) + len(b) - same)


def _pair_likeness(pairs: DataFrame, least: float) -> DataFrame:
    """(u, v, alike) of the pairs (u, v, su, sv) whose signatures are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                alike = (_signatures(batch.column(2), np.uint8) == _signatures(batch.column(3), np.uint8)).mean(axis=1)
                yield pa.record_batch({"u": batch.column(0), "v": batch.column(1), "alike": pa.array(alike)}).filter(pa.array(alike >= least))

    return pairs.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long, alike double")


def _texts(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """doc_id, text of the documents among ids (doc_id, at most `rows` rows, repeated ones too)."""
    ids = F.broadcast(ids) if rows <= BROADCAST_IDS else ids.distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (u, v) of doc_ids whose full shingle sets have 100 * intersection >= percent * union; a pair may come again where a doc_id has several texts.

    The partners of one u stream past its text, which comes once for each of the GROUPS groups that they are dealt over.
    """
    pairs = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(GROUPS)).cast("int").alias("s"))
    texts = _texts(docs, pairs.select(F.explode(F.array("u", "v")).alias("doc_id")), 2 * pairs.count())
    firsts = pairs.select("u", "s").distinct().select(F.col("u").alias("doc_id"), "u", "s", F.lit(0).alias("part"))
    wanted = firsts.unionByName(pairs.select(F.col("v").alias("doc_id"), "u", "s", F.lit(1).alias("part")))
    rows = salted_join(wanted, texts, ["doc_id"], salts=2).select("u", "s", "part", F.col("doc_id").alias("v"), "text")
    rows = rows.repartition(partitions(docs.sparkSession), "u", "s").sortWithinPartitions("u", "s", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []  # the sets of u: several if its doc_id has several texts
        for batch in batches:
            u, s, part, v = (batch.column(i).to_numpy() for i in range(4))
            good = np.zeros(len(batch), bool)
            for low, sets in shingle_sets(batch.column(4), shingle):
                for i, found in enumerate(sets, low):
                    if key != (u[i], s[i]):
                        key, own = (u[i], s[i]), []
                    if part[i]:
                        good[i] = any(linked(x, found, percent) for x in own)
                    elif not any(np.array_equal(x, found) for x in own):
                        own.append(found)
            yield pa.record_batch({"u": batch.column(0), "v": batch.column(3)}).filter(pa.array(good))

    return rows.mapInArrow(run, "u long, v long")


def _frequencies(texts: DataFrame, shingle: int) -> np.ndarray:
    """For each of 2^SKETCH slots of the shingle hashes, how many sets of the texts (doc_id, text) hold one in it: of a fixed size, whatever the texts are."""
    slots, wide = 1 << SKETCH, 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for _, sets in shingle_sets(batch.column(1), shingle):
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(total)
        blocks, first = np.unique(at // wide, return_index=True)
        bounds = pa.array(np.r_[first, len(at)], pa.int32())
        yield pa.record_batch({"block": pa.array(blocks, pa.int32()), "slot": pa.ListArray.from_arrays(bounds, pa.array(at % wide, pa.int32())), "n": pa.ListArray.from_arrays(bounds, pa.array(total[at]))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                np.add.at(sums.setdefault(block, np.zeros(wide, np.int64)), batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy())
        yield pa.record_batch({"block": pa.array(list(sums), pa.int32()), "n": pa.array(list(sums.values()), pa.list_(pa.int64()))})

    parts = texts.select("doc_id", "text").mapInArrow(count, "block int, slot array<int>, n array<long>")
    got = parts.repartition(min(partitions(texts.sparkSession), slots // wide), "block").mapInArrow(add, "block int, n array<long>").toArrow()
    out = np.zeros((slots // wide, wide), np.uint32)
    for block, n in zip(got.column(0).to_pylist(), got.column(1), strict=True):
        out[block] = np.minimum(n.values.to_numpy(), 0xFFFFFFFF)
    return out.ravel()


def _shared_rare(texts: DataFrame, known: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(u, v): all pairs of the classes (doc_id, text) in different components `known` (doc_id, comp) that can have the wanted similarity by their rarest shingles, lengths and places.

    Shingles are ordered by the count of their slot, then by themselves: any order that is the same for all loses no pair, one by
    counts keeps the frequent ones out.  Of two linked sets the longer, of m shingles, holds one of the shared
    ones among its m - ceil(m p) + 1 first, the shorter among its m - ceil(2 m p / (1 + p)) + 1 first.  One that is alone in its slot can't be shared.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(_frequencies(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets in shingle_sets(batch.column(1), shingle):
                sizes, places, firsts = [], [], []
                for x in sets:
                    n = sent.value[x >> np.uint64(64 - SKETCH)]
                    most, alone = len(x) - -(-len(x) * percent // 100) + 1, int((n < 2).sum())
                    order = np.lexsort((x, n))[alone:most]
                    sizes.append(len(order))
                    places.append(np.arange(alone, alone + len(order)))
                    firsts.append(x[order])
                row = np.repeat(np.arange(len(sets)), sizes)
                lengths = np.array([len(x) for x in sets], np.int64)
                yield pa.record_batch(
                    {
                        "rep": batch.column(0).take(pa.array(low + row)), "comp": batch.column(2).take(pa.array(low + row)), "m": pa.array(lengths[row], pa.int32()),
                        "h": pa.array(np.concatenate(firsts).view(np.int64)), "at": pa.array(np.concatenate(places), pa.int32()),
                    }
                )

    first = salted_join(texts, known, ["doc_id"], salts=1).select("doc_id", "text", "comp").mapInArrow(run, "rep long, comp long, m int, h long, at int")
    first = written(spark, first, "prefixes")
    mixed = first.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("h")
    first = written(spark, salted_join(first, mixed, ["h"], "left_semi"), "prefixes")
    short = first.where(f"at <= m - int(ceil(2 * m * {percent} / {100 + percent}))")
    x, y = (f.select("h", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "m", "at", "comp"))) for k, f in (("x", short), ("y", first)))
    met = salted_join(y, x, ["h"]).where(f"""comp_x <> comp_y AND (m_x < m_y OR m_x = m_y AND rep_x < rep_y) AND 100 * m_x >= {percent} * m_y
        AND {100 + percent} * least(m_x - at_x, m_y - at_y) >= {percent} * (m_x + m_y)""")
    return met.select(F.least("rep_x", "rep_y").alias("u"), F.greatest("rep_x", "rep_y").alias("v")).distinct()


def _likeliest(pairs: DataFrame) -> DataFrame:
    """For each end its most alike partner."""
    ends = pairs.select("u", "v", "alike", F.col("u").alias("e")).union(pairs.select("u", "v", "alike", F.col("v").alias("e")))
    return ends.groupBy("e").agg(F.max_by(F.struct("u", "v"), F.struct("alike", F.xxhash64("u", "v"))).alias("p")).select("p.u", "p.v").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id) for each row of docs."""
    small_batches(docs.sparkSession)
    with scratch():
        return _near_duplicates(docs, percent, shingle)


def _near_duplicates(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    spark = docs.sparkSession
    rows = written(spark, sketches(docs, shingle), "sketches", keep=True)
    nodes = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(spark, nodes.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.min("low").alias("low")), "classes")
    regions, crowd = _regions(classes)
    short = classes.select("rep", F.col("low").alias("sig"))
    # Rows of crowds stand in the same table, without a region.
    both = regions.unionByName(crowd.withColumn("region", F.lit(None).cast("long")))
    both = written(spark, salted_join(both, short, ["rep"], salts=1), "regions")
    regions, crowd = both.where("region IS NOT NULL"), both.where("region IS NULL").select("top", "rep", "sig")
    least = percent / 100 - SLACK

    trees = written(spark, _trees(regions, least), "trees")
    centres = trees.where("top IS NOT NULL").groupBy("top").agg(F.max_by(F.struct("u", "sig"), F.struct("n", "u")).alias("c")).select("top", F.col("c.u").alias("centre"), F.col("c.sig").alias("sv"))
    around = salted_join(crowd, centres, ["top"]).where("rep <> centre")
    around = around.select(F.least("rep", "centre").alias("u"), F.greatest("rep", "centre").alias("v"), F.col("sig").alias("su"), "sv")

    def with_signatures(pairs: DataFrame) -> DataFrame:
        pairs = salted_join(pairs, short.select(F.col("rep").alias("u"), F.col("sig").alias("su")), ["u"])
        return salted_join(pairs, short.select(F.col("rep").alias("v"), F.col("sig").alias("sv")), ["v"])

    pairs = trees.where("top IS NULL").select("u", "v", "alike").union(_pair_likeness(around, least))
    pairs = written(spark, pairs.groupBy("u", "v").agg(F.max("alike").alias("alike")), "pairs")

    def named(frame: DataFrame, known: DataFrame, c: str) -> DataFrame:
        found = known.select(F.col("node").alias(c), F.col("component").alias(f"comp_{c}"))
        return joined(frame, found, [c], known.count(), "left").withColumn(f"comp_{c}", F.coalesce(f"comp_{c}", c))

    # Each class's likeliest candidate; then the other candidates between the components found.
    tried = written(spark, _likeliest(pairs), "tried")
    links = written(spark, confirm(tried, docs, percent, shingle), "links")
    known = extend(None, links)

    def apart(known: DataFrame) -> DataFrame:
        return named(named(pairs, known, "u"), known, "v").where("comp_u <> comp_v").select("u", "v")

    more = written(spark, apart(known).join(tried, ["u", "v"], "left_anti"), "more")
    if more.limit(1).count():
        found = written(spark, confirm(more, docs, percent, shingle), "links")
        known, tried = extend(known, found), tried.select("u", "v").union(more)
    # Classes of regions and crowds that are still of several components: exactly, whatever region they are in or fell out of.
    suspects = _suspects(named(regions, known, "rep").withColumnRenamed("comp_rep", "comp"), least)
    loose = written(spark, named(crowd.select("top", "rep"), known, "rep"), "loose")
    mixed = loose.groupBy("top").agg(F.min("comp_rep").alias("a"), F.max("comp_rep").alias("b")).where("a <> b").select("top")
    loose = salted_join(loose, mixed, ["top"], "left_semi").select("rep").union(suspects).distinct()
    loose = written(spark, named(loose, known, "rep").select(F.col("rep").alias("doc_id"), F.col("comp_rep").alias("comp")), "loose")
    if loose.limit(1).count():
        texts = _texts(docs, loose.select("doc_id"), loose.count())
        more = written(spark, _pair_likeness(with_signatures(_shared_rare(texts, loose, percent, shingle).join(tried, ["u", "v"], "left_anti")), least), "more")
        if more.limit(1).count():
            known = extend(known, written(spark, confirm(more.select("u", "v"), docs, percent, shingle), "links"))
    same = nodes.join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
    alone = nodes.groupBy("doc_id").agg(F.count_distinct("d1", "d2").alias("n")).where("n > 1").select("doc_id")
    # A doc_id with several texts ties their classes together.
    ties = same.join(alone, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    known = extend(known, ties)
    classes = joined(classes.select("d1", "d2", "rep"), known.select(F.col("node").alias("rep"), "component"), ["rep"], known.count(), "left", salts=1)
    names = written(spark, classes.select("d1", "d2", F.coalesce("component", "rep").alias("component")), "names", keep=True)
    out = salted_join(rows.select("doc_id", "n_shingles", "d1", "d2"), names, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


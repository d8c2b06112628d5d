"""Token ids in binary files: a shared zstandard dictionary, each document compressed on its own.

A file holds a range of documents in ascending doc_id order: a magic word, a JSON header (version,
dictionary hash, dictionary, end id), the compressed id arrays one after another, and an offset
index: for each document its doc_id, its place in the file and its number of ids.  Ids are serialised
as unsigned little-endian integers, of two bytes where the vocabulary allows it, else of four.  A document is read by one range of bytes and the dictionary, which
is trained once on a bounded sample of serialised id arrays and is the same in all files.  A text
is encoded by a tokenizer file of the tokenizers library without special tokens; the strings of
special tokens in a text are ordinary text.

Files are rows of (file, content) so that Spark writes and reads them on any store.  Null and empty
texts are the end id alone.  Repeated rows are kept, each with a place of its own; rows without a
doc_id come first.  Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import io
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalspark.llm.chunks import ChunkEncoder
from vitalspark.llm.common import partitions

MAGIC, VERSION, END_ID = b"VTOK", 1, 2
#: Bytes of the dictionary, documents that it is trained on and characters of each, rows of a file, zstandard level.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS, FILE_ROWS, LEVEL = 64 << 10, 400, 20_000, 1000, 3


@functools.cache
def _tokenizer(path: str):
    # Spark runs a task a core: threads of the library's own take CPU from other tasks, and memory for each thread.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


_CONTINUES = (np.arange(256) & 0xC0) == 0x80
#: Bytes that start characters none of which is white space: ASCII graphics, and leads other than those of U+0080-00BF, U+1000-1FFF, U+2000-2FFF and U+3000-3FFF.
_NO_SPACE = np.array([(0x21 <= b <= 0x7E) or (b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3)) for b in range(256)])


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks that the byte-level pre-tokenizer treats apart: each text, and each space or line feed right after a character that isn't white space.

    No pre-token goes from such a character to white space, and what follows white space never depends on what stands before it.
    """
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[at > 0]
    lead = at - 1
    for _ in range(3):
        lead = np.where(_CONTINUES[data[lead]], np.maximum(lead - 1, 0), lead)
    return np.union1d(at[_NO_SPACE[data[lead]]], offsets[:-1][offsets[1:] > offsets[:-1]])


@functools.cache
def _token_bytes(path: str) -> np.ndarray:
    """Bytes of text that each id stands for: a byte-level piece has a character for each."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for piece, i in vocabulary.items():
        out[i] = len(piece)
    return out


#: Characters of chunks that are handed to the library as one text.
JOINED = 20_000


def _encode_chunks(chunks: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of chunks, one after another, and how many each has.

    Chunks that start with a space or line feed and end with something else are treated apart also side by side: many make
    one text for the library, and the bytes of its ids tell where each chunk ends. The others are texts of their own.
    """
    texts, owners, size = [[]], [[]], 0
    for i, x in enumerate(chunks):
        alone = x[0] not in " \n" or x[-1].isspace()
        if alone or size > JOINED:
            texts.append([])
            owners.append([])
            size = 0
        texts[-1].append(x)
        owners[-1].append(i)
        size = JOINED + 1 if alone else size + len(x)
    found = _tokenizer(path).encode_batch_fast(["".join(x) for x in texts], add_special_tokens=False)
    parts = [np.array(x.ids, np.uint32) for x in found]
    sizes = np.zeros(len(chunks), np.int64)
    for own, text, ids in zip(owners, texts, parts, strict=True):
        if len(own) == 1:
            sizes[own] = len(ids)
        elif own:
            ends = np.searchsorted(np.cumsum(_token_bytes(path)[ids]), np.cumsum([len(x.encode()) for x in text])) + 1
            sizes[own] = np.diff(ends, prepend=0)
    return np.concatenate(parts), sizes


_encoders: dict[str, ChunkEncoder] = {}


def encode(texts: pa.Array, path: str, end_id: int = END_ID) -> Iterator[np.ndarray]:
    """The ids of each text, and the end id."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(lambda chunks: _encode_chunks(chunks, path), _cuts)
    for ids in _encoders[path].encode(texts):
        yield np.append(ids, np.uint32(end_id)).astype("<u4")


def width(path: str) -> str:
    """The number type of serialised ids."""
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, path: str, sample: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary from the id arrays of the documents with the `sample` least hashes of their text; empty if they are too few to train on."""
    hashed = docs.where("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    least = [r[0] for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    texts = [r[0] for r in hashed.where(F.col("h") <= (least[-1] if least else 0)).groupBy("h").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text")).orderBy("h").select("text").limit(sample).collect()]
    arrays = [x.astype(width(path)).tobytes() for x in encode(pa.array(texts, pa.string()), path)]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(ids: list[int | None], arrays: list[np.ndarray], dictionary: bytes, kind: str = "<u4", end_id: int = END_ID) -> bytes:
    """One file."""
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
    head = json.dumps({"version": VERSION, "dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "dictionary_bytes": len(dictionary), "ids": kind, "end_id": end_id}).encode()
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<I", len(head)) + head + dictionary)
    index = np.zeros(len(ids), [("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("bytes", "<u8"), ("n", "<u8")])
    for i, (doc_id, x) in enumerate(zip(ids, arrays, strict=True)):
        body = packer.compress(x.astype(kind).tobytes())
        index[i] = (0 if doc_id is None else doc_id, doc_id is not None, out.tell(), len(body), len(x))
        out.write(body)
    place = out.tell()
    out.write(index.tobytes() + struct.pack("<QQ", place, len(ids)) + MAGIC)
    return out.getvalue()


class Reader:
    """Access to the documents of one file by their place in it."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC or content[-4:] != MAGIC:
            raise ValueError("not a token file")
        self.content = content
        (n,) = struct.unpack_from("<I", content, 4)
        self.header = json.loads(content[8 : 8 + n])
        dictionary = content[8 + n : 8 + n + self.header["dictionary_bytes"]]
        if hashlib.sha256(dictionary).hexdigest() != self.header["dictionary_sha256"]:
            raise ValueError("the dictionary is not the one that the documents were compressed with")
        self._unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        place, count = struct.unpack_from("<QQ", content, len(content) - 20)
        self.index = np.frombuffer(content, [("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("bytes", "<u8"), ("n", "<u8")], count, place)

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, i: int) -> int | None:
        return int(self.index["doc_id"][i]) if self.index["has_id"][i] else None

    def ids(self, i: int) -> np.ndarray:
        at, size = int(self.index["offset"][i]), int(self.index["bytes"][i])
        return np.frombuffer(self._unpacker.decompress(self.content[at : at + size]), self.header["ids"]).astype("<u4")


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, file_rows: int = FILE_ROWS) -> None:
    """Write docs to files of about file_rows documents: rows (part, seq, first_id, last_id, n_ids, content) as Parquet.

    Parts are ranges of doc_id in order, each sorted and cut to files by its own task; rows alike in doc_id are ordered by text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sent, kind = spark.sparkContext.broadcast(train_dictionary(docs, path)), width(path)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, arrays = TaskContext.get().partitionId(), 0, [], []

        def file() -> pa.RecordBatch:
            known = [x for x in ids if x is not None] or [None]
            row = {"part": part, "seq": seq, "first_id": known[0], "last_id": known[-1], "n_ids": sum(map(len, arrays)), "content": pack(ids, arrays, sent.value, kind, end_id)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())]))

        for batch in batches:
            for doc_id, array in zip(batch.column(0).to_pylist(), encode(batch.column(1), path, end_id), strict=True):
                ids.append(doc_id)
                arrays.append(array.astype(kind))
                if len(ids) >= file_rows:
                    yield file()
                    seq, ids, arrays = seq + 1, [], []
        if ids:
            yield file()

    spread = docs.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    spread.mapInArrow(files, "part int, seq int, first_id long, last_id long, n_ids long, content binary").write.parquet(folder)


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, for each document of the files.

    With digest ids_crc32, the unsigned crc32 of its ids as little-endian unsigned 32-bit integers, takes the place of ids.
    """
    files = spark.read.parquet(folder)
    last = "ids_crc32 long" if digest else "ids array<int>"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                reader = Reader(content)
                n = reader.index["n"].astype(np.int64)
                inside = np.cumsum(n) - n
                for low in range(0, len(reader), 200):
                    some = range(low, min(low + 200, len(reader)))
                    arrays = [reader.ids(i) for i in some]
                    ids = pa.array([zlib.crc32(x) for x in arrays], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in arrays], pa.list_(pa.int32()))
                    yield pa.record_batch(
                        {
                            "part": pa.array([part] * len(some), pa.int32()),
                            "seq": pa.array([seq] * len(some), pa.int32()),
                            "doc_id": pa.array([reader.doc_id(i) for i in some], pa.int64()),
                            "inside": pa.array(inside[some.start : some.stop]),
                            "n_tokens": pa.array(n[some.start : some.stop]),
                            last.split()[0]: ids,
                        }
                    )

    rows = files.select("part", "seq", "content").mapInArrow(documents, f"part int, seq int, doc_id long, inside long, n_tokens long, {last}")
    placed = rows.join(file_starts(files), ["part", "seq"])
    return placed.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", last.split()[0])


def fetch(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of some documents: only files that can hold them are opened, only these documents decompressed."""
    wanted = sorted(set(doc_ids))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                reader = Reader(content)
                places = [i for i in np.flatnonzero(np.isin(reader.index["doc_id"], wanted)) if reader.doc_id(i) is not None]
                yield pa.record_batch({"doc_id": pa.array([reader.doc_id(i) for i in places], pa.int64()), "ids": pa.array([reader.ids(i).astype(np.int32) for i in places], pa.list_(pa.int32()))})

    holds = F.exists(F.array(*map(F.lit, wanted)), lambda x: x.between(F.col("first_id"), F.col("last_id")))
    return spark.read.parquet(folder).where(holds).select("content").mapInArrow(some, "doc_id long, ids array<int>")


def file_starts(files: DataFrame) -> DataFrame:
    """(part, seq, before): the ids of all files before each one. Parts are summed first, so only one row a part meets in one place."""
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("inner"))
    return within.join(parts.select("part", "earlier"), "part").select("part", "seq", (F.col("inner") + F.col("earlier")).alias("before"))

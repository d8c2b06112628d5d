"""SentencePiece encoding and decoding by a streaming Viterbi search.

The trellis has a node at each character boundary and an edge for each piece of the vocabulary.
The model file is of the BPE kind, in which a segmentation is right if every two neighbouring
pieces are: encoding their joint text gives these two.  Exactly one edge into each reached node
continues a right path, so the survivor at a node is the one whose last two pieces fit; the ids are
those of the library.  (The greatest sum of the file's scores would be another segmentation.)

A piece is at most `longest` characters, so that later nodes only continue from the last `longest`
nodes.  When the backpointer paths of these all meet in one boundary, everything before it is
committed and forgotten: a text of any length needs a window only.

Spaces are the character U+2581, with one put in front; a text's own U+2581 decodes to a space.
Characters outside the vocabulary are their UTF-8 bytes.  Null and empty texts have no ids.
Repeated rows each have their result.  Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.chunks import ChunkEncoder

SPACE = "▁"
#: Characters between attempts to commit.
COMMIT_EVERY = 64


class Pieces:
    """The pieces of a model file, and what the search needs of them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(count)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(count) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.control = {i for i in range(count) if model.is_control(i) or model.is_unknown(i)}
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.longest = max(map(len, self.id))
        #: Ends of pieces: the id of a piece, -1 for a text that only ends longer ones.
        self.tails = {x[i:]: -1 for x in self.id for i in range(len(x))} | self.id
        self.fits: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging, best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.score[x], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fit(self, left: int, right: int) -> bool:
        """Whether a right path may have these neighbours; -1 is a character outside the vocabulary, or the start."""
        if left < 0:
            return True
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[key] = self.merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
        return found

    def extend(self, window: str, last: list[int], back: list[int]) -> None:
        """Nodes for the characters of window that have none: the last piece of each survivor (-1: a character outside the vocabulary, -2: no node) and where it starts."""
        tails, fits = self.tails.get, self.fits.get
        for stop in range(len(last), len(window) + 1):
            piece, node, start = -2, 0, stop
            while start:
                start -= 1
                found = tails(window[start:stop])
                if found is None:  # no piece ends like this
                    break
                if found >= 0:
                    left = last[start]
                    if left == -2:
                        continue
                    fitting = True if left < 0 else fits(left << 32 | found)
                    if fitting or (fitting is None and self.fit(left, found)):
                        piece, node = found, start
                        break
            if piece == -2 and window[stop - 1] not in self.id:
                piece, node = -1, stop - 1
            last.append(piece)
            back.append(node)

    def path(self, window: str, last: list[int], back: list[int], stop: int) -> list[int]:
        """Ids of the survivor that ends at a node."""
        parts: list = []
        while stop:
            start = back[stop]
            parts.append(last[stop] if last[stop] >= 0 else [self.byte[b] for b in window[start:stop].encode()])
            stop = start
        parts.reverse()
        return parts if all(x.__class__ is int for x in parts) else [y for x in parts for y in (x if isinstance(x, list) else [x])]

    def whole(self, text: str) -> list[int]:
        """Ids of a chunk, whose end all paths meet in."""
        last, back = [-1], [0]
        self.extend(text, last, back)
        return self.path(text, last, back, len(text))


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Stream:
    """Encodes a text that arrives in parts; holds the nodes since the last commit only."""

    def __init__(self, vocabulary: Pieces):
        self.v, self.window, self.last, self.back = vocabulary, "", [-1], [0]
        self.widest = 0

    def feed(self, text: str) -> Iterator[int]:
        """Take more characters in (spaces as U+2581); give the ids that no later character can change."""
        for at in range(0, len(text), COMMIT_EVERY):
            self._extend(text[at : at + COMMIT_EVERY])
            yield from self._commit(self._meeting())

    def end(self) -> Iterator[int]:
        yield from self._commit(len(self.window))

    def _extend(self, text: str) -> None:
        self.window += text
        self.v.extend(self.window, self.last, self.back)
        self.widest = max(self.widest, len(self.window))

    def _meeting(self) -> int:
        """The boundary in which the paths of all nodes that can be continued meet."""
        n = len(self.window)
        nodes = {i for i in range(max(0, n - self.v.longest + 1), n + 1) if self.last[i] != -2}
        while len(nodes) > 1:
            top = max(nodes)
            nodes.remove(top)
            nodes.add(self.back[top])
        return nodes.pop()

    def _commit(self, stop: int) -> list[int]:
        ids = self.v.path(self.window, self.last, self.back, stop)
        if stop:
            self.window, self.last = self.window[stop:], self.last[stop:]
            self.back = [0, *(x - stop for x in self.back[stop + 1 :])]
        return ids


def encode_text(text: str, path: str) -> list[int]:
    """Ids of a whole text by the streaming search."""
    if not text:
        return []
    stream = Stream(pieces(path))
    return [*stream.feed((" " + text).replace(" ", SPACE)), *stream.end()]


def decode(ids: list[int], path: str) -> str:
    """Text of ids: pieces joined, runs of bytes read as UTF-8, U+2581 back to spaces, the one in front taken off."""
    v = pieces(path)
    data = b"".join(bytes([v.of_byte[i]]) if i in v.of_byte else b"" if i in v.control else v.text[i].encode() for i in ids)
    text = data.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks on whose borders all paths meet: texts, and spaces right after another character: no piece has U+2581 but in front."""
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    before = data[at - 1]
    mark = (before == 0x81) & (data[np.maximum(at - 2, 0)] == 0x96) & (data[np.maximum(at - 3, 0)] == 0xE2)
    return np.union1d(at[(before != 0x20) & ~mark], offsets[:-1][offsets[1:] > offsets[:-1]])


_encoders: dict[str, ChunkEncoder] = {}


def encode(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text."""
    if path not in _encoders:
        v = pieces(path)

        def chunks(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids, sizes = [], []
            for x in found:
                before = len(ids)
                if len(x) <= COMMIT_EVERY:
                    ids += v.whole(x.replace(" ", SPACE))
                else:
                    stream = Stream(v)
                    ids += stream.feed(x.replace(" ", SPACE))
                    ids += stream.end()
                sizes.append(len(ids) - before)
            return np.array(ids, np.uint32), np.array(sizes, np.int64)

        if any(SPACE in x.lstrip(SPACE) for x in v.id):
            raise ValueError("pieces of this model go over spaces: its texts can't be cut there")
        _encoders[path] = ChunkEncoder(chunks, _cuts)
    # The space in front of a text makes its first word a chunk like others.
    for low in range(0, len(texts), 500):
        yield from _encoders[path].encode(pa.array([" " + x if x else "" for x in texts.slice(low, 500).to_pylist()], pa.string()))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                yield pa.record_batch({"doc_id": part.column(0), "ids": pa.array([x.astype(np.int32) for x in encode(part.column(1), path)], pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text of each row of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("text", pa.array([decode(x, path) for x in batch.column(1).to_pylist()], pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256, same (decoded equals the text), of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                ids = list(encode(part.column(1), path))
                back = [decode(x.tolist(), path) for x in ids]
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n_ids": pa.array([len(x) for x in ids], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                        "same": pa.array([x == (y or "") for x, y in zip(back, part.column(1).to_pylist(), strict=True)], pa.bool_()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")


def encode_and_check(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids, same (whether the ids decode to the text; null as empty) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                ids = list(encode(part.column(1), path))
                same = [decode(x.tolist(), path) == (y or "") for x, y in zip(ids, part.column(1).to_pylist(), strict=True)]
                yield pa.record_batch({"doc_id": part.column(0), "n_ids": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), "same": pa.array(same, pa.bool_())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, same boolean")

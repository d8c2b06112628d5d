"""Words, word hashes and word n-grams of Arrow text batches, by numpy over the UTF-8 bytes.

Splitting on single-byte separators never cuts a UTF-8 sequence, so working on bytes gives the
same words as working on code points.  Hashes are 64-bit polynomials over the bytes (modulo 2^64,
odd base), finalised by a mixer.  Nulls count as empty texts and give no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

_ALL = np.arange(256)
_LOWERED = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
#: True at bytes of words split by white space: [^\x20\x09-\x0D]+
SPACE_WORDS = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: True at bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
ALNUM_WORDS = (_ALL >= 0x80) | ((_LOWERED >= 0x61) & (_LOWERED <= 0x7A)) | ((_ALL >= 0x30) & (_ALL <= 0x39))
#: True at bytes of [^\x00-\x40\x5B-\x60\x7B-\x7F]+, before or after A-Z are lower-cased.
LETTER_WORDS = (_ALL >= 0x80) | ((_LOWERED >= 0x61) & (_LOWERED <= 0x7A))


class Words(NamedTuple):
    """Words of some documents in order: hash, index of the document, byte span."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = -(-n // 65536) * 65536
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial; span_hash() takes the hash of any span from it."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values) + 1)[0][: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], equal for equal value sequences wherever they stand."""
    return mix((sums[end] - sums[start]) * _power(len(sums))[1][start] + (end - start).astype(np.uint64))


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial over bytes, for span_hash()."""
    return prefix_sums(_BYTE_VALUES[data])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offset of each row and the end) for runs of rows of about `limit` bytes."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, every[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWERED[data]


def spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of the documents whose bytes are data[offsets[i]:offsets[i + 1]]."""
    inside = classes[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begins, ends = offsets[:-1][full], offsets[1:][full] - 1
    first[begins], last[ends] = inside[begins], inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def tokenize(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool) -> Words:
    """Words of the documents whose bytes are data[offsets[i]:offsets[i + 1]]."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none)
    start, end = spans(data, offsets, classes)
    values = (_BYTE_VALUES[_LOWERED] if lower else _BYTE_VALUES)[data]
    return Words(span_hash(prefix_sums(values), start, end), np.searchsorted(offsets, start, side="right") - 1, start, end)


def word_hashes(texts: pa.Array, classes: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of all words of the texts, as tokenize() has them, taken slice by slice: tokenize() needs some forty bytes for a byte of text."""
    parts = [(words.hash, words.doc + low) for low, _, data, offsets in slices(texts) for words in [tokenize(data, offsets, classes, lower)]]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, docs = zip(*parts, strict=True)
    return np.concatenate(hashes), np.concatenate(docs)


def whole(doc: np.ndarray, length: int) -> np.ndarray:
    """Starts of the runs of `length` words that lie in one document."""
    if len(doc) < length:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - length + 1] == doc[length - 1 :])


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Index of the first word of each of n documents, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))

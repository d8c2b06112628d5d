"""Secret scans: a worklist of layers, each rescanned, until decoding gives nothing new.

The first layer is the text.  From each layer come: its percent escapes decoded, its backslash
escapes (u, U, u{}, x) decoded, its numeric character references decoded, and what each base64 run
holds - from each of its first four characters, and over line ends - as it is or compressed by zlib,
gzip, bzip2 or xz, also behind other bytes.  A layer whose content was met before at the same place
ends there, so cycles end; equal content at another place is a layer of its own.  Each character of
a layer knows the span of the text that it comes from: finds in inner layers are reported as spans of the text.

All that is looked for is ASCII, so layers hold nothing else: of decoded bytes the stretches of ASCII
text, of decoded escapes the stretches around them up to characters that no find and no wrapping can
contain.  Compressed data is unpacked and looked at stretch by stretch; all of it has the span of its run.
An escape character that is itself escaped over and over (%252525...) is taken down to its last escape at once.

Base finds are those of the text itself.  Null and empty texts have none.  Positions are code
points, ends exclusive.  Repeated rows each have their result.  Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
#: A run that is long enough is the whole run: shorter runs can't hide a longer one.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6
#: Texts without any of these have no finds and no inner layers; the scan of a batch for them is vectorised.
WORTH = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\u\{?[0-9A-Fa-f]|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9xX]|&amp;#|[A-Za-z0-9+/_-]{16}"
_WORTH = re.compile(WORTH)
PERCENT = re.compile(r"(?P<again>%25(?:25)+)|%(?P<hex>[0-9A-Fa-f]{2})")
ESCAPE = re.compile(r"(?P<again>\\(?:u005[cC](?:u005[cC])+|x5[cC](?:x5[cC])+))|\\(?:u(?P<u>[0-9A-Fa-f]{4})|u\{(?P<long>[0-9A-Fa-f]{1,6})\}|U(?P<U>[0-9A-Fa-f]{8})|x(?P<x>[0-9A-Fa-f]{2}))")
ENTITY = re.compile(r"(?P<again>&(?:#0*38;)(?:#0*38;)+)|(?P<amp>&amp;(?:amp;)*(?=#))|&#(?:(?P<ten>[0-9]{1,8})|[xX](?P<hex>[0-9A-Fa-f]{1,6}));")
#: Characters that neither a find nor anything wrapped contains.
BREAK = re.compile(r"""[^A-Za-z0-9+/_.="':%\\{}&#; \t\r\n-]""")
LAST_BREAK = re.compile(rb"""(?s:.*)[^A-Za-z0-9+/_.="':%\\{}&#; \t\r\n-]""")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs on lines that follow each other; further lines may be indented.
WRAPPED, LINE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+(?:\r?\n[ \t]*(?==))?|\r?\n[ \t]*(?==))={0,2}"), re.compile(r"[A-Za-z0-9+/_-]+")
_PLAIN = str.maketrans("-_", "+/")
#: Stretches of bytes that can hold anything, starts of compressed data, and bytes unpacked at a time.
STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{6,}")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
PIECE = 1 << 20


class Layer:
    """Text, and for each character the span of the document that it comes from (None: the document itself)."""

    def __init__(self, text: str, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.text, self.low, self.high = text, low, high

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.low is None:
            return start, end
        return int(self.low[start:end].min()), int(self.high[start:end].max())

    def ends(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.low is None:
            at = np.arange(start, end)
            return at, at + 1
        return self.low[start:end], self.high[start:end]

    def key(self) -> bytes:
        """A digest of content and place.  What comes out of compressed data has one span for all characters, and other layers are shorter than what they come from: only so many keys can follow."""
        place = b"" if self.low is None else self.low.tobytes() + self.high.tobytes()
        return hashlib.blake2b(self.text.encode() + b"\0" + place, digest_size=16).digest()


def scan(text: str) -> list[tuple[str, int, int]]:
    """Finds of one layer: leftmost, non-overlapping of each kind; assignments of short values are dropped after they are matched."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    return found + [(k, *m.span()) for k, p in (("access", ACCESS), ("hex", HEX)) for m in p.finditer(text)]


def _percent(m: re.Match) -> str:
    return "%25" if m["again"] else chr(int(m["hex"], 16))


def _escape(m: re.Match) -> str:
    if m["again"]:
        return m["again"][: 6 if m["again"][1] == "u" else 4]
    code = int(m["u"] or m["long"] or m["U"] or m["x"], 16)
    return chr(code) if code < 128 else "\ufffd"


def _entity(m: re.Match) -> str:
    if m["again"] or m["amp"]:
        return "&#38;" if m["again"] else "&"
    code = int(m["ten"]) if m["ten"] else int(m["hex"], 16)
    return chr(code) if code < 128 else "\ufffd"


ESCAPES: tuple[tuple[str, re.Pattern, Callable[[re.Match], str]], ...] = (("%", PERCENT, _percent), ("\\", ESCAPE, _escape), ("&", ENTITY, _entity))


def _decoded(layer: Layer, pattern: re.Pattern, decode: Callable[[re.Match], str]) -> Iterator[Layer]:
    """The stretches of a layer in which pattern matches, with its matches decoded."""
    text, breaks, begin, end = layer.text, [], 0, -1
    texts, lows, highs, at = [], [], [], 0
    for m in [*pattern.finditer(text), None]:
        if m is None or m.start() >= end:
            if end >= 0:  # the stretch before is whole
                low, high = layer.ends(at, end)
                yield Layer("".join([*texts, text[at:end]]), np.concatenate([*lows, low]), np.concatenate([*highs, high]))
            if m is None:
                return
            breaks = breaks or [x.start() for x in BREAK.finditer(text)] or [len(text)]
            i = bisect.bisect_left(breaks, m.start())
            begin, end = breaks[i - 1] + 1 if i else 0, breaks[i] if i < len(breaks) else len(text)
            texts, lows, highs, at = [], [], [], begin
        low, high = layer.ends(at, m.start())
        inner, span = decode(m), layer.span(*m.span())
        texts += [text[at : m.start()], inner]
        lows += [low, np.full(len(inner), span[0])]
        highs += [high, np.full(len(inner), span[1])]
        at = m.end()


def _unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What compressed data holds, piece by piece, as far as it is sound."""
    data = next(chunks, b"")
    deflated = data[:1] in (b"\x1f", b"\x78")
    opener = zlib.decompressobj(47) if deflated else bz2.BZ2Decompressor() if data[:1] == b"B" else lzma.LZMADecompressor()
    try:
        while not opener.eof:
            out = opener.decompress(data, PIECE)
            data = opener.unconsumed_tail if deflated else b""
            if out:
                yield out
            hungry = not data and len(out) < PIECE if deflated else opener.needs_input
            if hungry and not opener.eof and not (data := next(chunks, b"")):
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return


def _levels(data: bytes) -> Iterator[Callable[[], Iterator[bytes]]]:
    """Readers of what data holds if it is compressed, of what that holds, and so on; data that holds itself ends the row."""
    met, reader = set(), lambda: iter([data])
    while True:
        reader = (lambda above: lambda: _unpacked(above()))(reader)
        digest, start = hashlib.blake2b(digest_size=16), b""
        for piece in reader():
            digest.update(piece)
            start = start if len(start) >= 16 else start + piece[:16]
        if not start or digest.digest() in met:
            return
        met.add(digest.digest())
        yield reader
        if not PACKED.match(start):
            return


def _stretches(pieces: Iterator[bytes]) -> Iterator[str]:
    """The stretches of ASCII text in data that comes in pieces; over the ends of pieces they go on up to a character that no find and no wrapping can contain."""
    rest: list[bytes] = []
    for piece in pieces:
        if cut := LAST_BREAK.match(piece):
            for m in STRETCH.finditer(b"".join([*rest, piece[: cut.end()]])):
                yield m[0].decode()
            rest, piece = [], piece[cut.end() :]
        rest.append(piece)
    for m in STRETCH.finditer(b"".join(rest)):
        yield m[0].decode()


def _runs(text: str) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """Base64 runs, without padding, in the plain alphabet: characters, the places of the lines that they come from, and the end with padding.

    Of lines that follow each other: each one, all, those of one width with the shorter one behind, and these without it.
    """
    for m in BASE64.finditer(text):
        run = m[0].rstrip("=").translate(_PLAIN)
        yield run, [(m.start(), m.start() + len(run))], m.end()
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        lines = [x.span() for x in LINE.finditer(text, m.start(), m.end())]
        groups, at = {(0, len(lines))}, 0
        while at < len(lines):
            wide, to = lines[at][1] - lines[at][0], at + 1
            while to < len(lines) and lines[to][1] - lines[to][0] == wide:
                to += 1
            shorter = to < len(lines) and lines[to][1] - lines[to][0] < wide
            groups |= {(at, to), (at, to + shorter)}
            at = to
        for a, b in sorted(groups):
            if b - a > 1 or b == len(lines) == 1:
                yield "".join(text[x:y] for x, y in lines[a:b]).translate(_PLAIN), lines[a:b], m.end() if b == len(lines) else lines[b - 1][1]


def inner_layers(layer: Layer) -> Iterator[Layer]:
    """The layers wrapped in one."""
    for sign, pattern, decode in ESCAPES:
        if sign in layer.text:
            yield from _decoded(layer, pattern, decode)
    for run, lines, last in _runs(layer.text):
        places = None
        for first in range(4):  # characters of the same alphabet may stand in front
            size = len(run) - first
            size -= size % 4 == 1  # a length that base64 never has: something stands behind, too
            data = binascii.a2b_base64(run[first : first + size] + "=" * (-size % 4))
            for m in STRETCH.finditer(data):
                if not _WORTH.search(text := m[0].decode()):
                    continue
                if places is None:
                    places = np.concatenate([np.arange(a, b) for a, b in lines])
                low, high = layer.ends(0, len(layer.text)) if layer.low is not None else (None, None)
                at = np.arange(m.start(), m.end() + 1)
                begin, end = places[first + at[:-1] * 4 // 3], places[first + np.minimum((at[1:] * 4 + 2) // 3, size) - 1]
                yield Layer(text, begin if low is None else low[begin], end + 1 if high is None else high[end])
            for m in PACKED.finditer(data):
                start = lines[0][0] + first + m.start() * 4 // 3 if len(lines) == 1 else lines[0][0] + first
                span = layer.span(start, last)
                for reader in _levels(data[m.start() :]):
                    for text in _stretches(reader()):
                        if _WORTH.search(text):
                            yield Layer(text, *(np.full(len(text), x) for x in span))


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base finds, finds of all layers), in order of start, then kind."""
    base = scan(text)
    spans, seen, work = set(base), set(), [inner_layers(Layer(text))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif (key := layer.key()) not in seen:
            seen.add(key)
            spans |= {(k, *layer.span(a, b)) for k, a, b in scan(layer.text)}
            work.append(inner_layers(layer))
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(spans, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with each stretch that spans cover replaced by mark."""
    out, at, last = [], 0, -1
    for a, b in sorted((a, b) for _, a, b in spans):
        if a >= max(last, 0):
            out += [text[at:a], mark]
        at = last = max(last, b)
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans (kind:start:end, comma-joined), redacted (the text without what spans cover; null for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                worth = pc.fill_null(pc.match_substring_regex(part.column(1), WORTH), False).to_pylist()
                texts = part.column(1).to_pylist()
                found = [find(x) if w else ([], []) for x, w in zip(texts, worth, strict=True)]
                columns = {f"n_{k}": pa.array([sum(x[0] == k for x in base) for base, _ in found], pa.int64()) for k in KINDS}
                yield pa.record_batch(
                    {"doc_id": part.column(0)}
                    | columns
                    | {"base": pa.array([joined(x) for x, _ in found], pa.string()), "spans": pa.array([joined(x) for _, x in found], pa.string()), "redacted": pa.array([redacted(t, x) if x else t for t, (_, x) in zip(texts, found, strict=True)], pa.string())}
                )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, redacted string")


def redact(docs: DataFrame) -> DataFrame:
    """Rows of docs, with all their columns: text redacted, and n_chars, if there is one, counted anew where text changed."""
    place = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed: dict[int, str] = {}
            texts = batch.column(place)
            for i in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, WORTH), False).to_numpy(zero_copy_only=False)).tolist():
                text = texts[i].as_py()
                spans = find(text)[1]
                if spans:
                    changed[i] = redacted(text, spans)
            for at, new in ((place, changed), (count, {i: len(x) for i, x in changed.items()})):
                if changed and at is not None:
                    old = batch.column(at)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array([new.get(i, x) for i, x in enumerate(old.to_pylist())], old.type))
            yield batch

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)

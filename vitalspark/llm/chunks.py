"""Encoding texts chunk by chunk, each distinct chunk once in a process.

A tokenizer treats some stretches of a text apart: what stands before or after doesn't change their
ids.  Such chunks, about the words, repeat all over a corpus, so that a process encodes those it
hasn't met and puts the ids of the others together from memory, which starts anew when it is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from vitalspark.llm import words as W

#: Chunks whose ids a process remembers, and new ones between two merges of them into the sorted rest.
REMEMBERED, FRESH = 1_500_000, 50_000


class ChunkEncoder:
    """encode_many: ids of some chunks one after another, and how many each has; cuts: starts of the chunks in bytes of texts (data, offsets), those of the texts among them."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cuts: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.encode_many, self.cuts = encode_many, cuts
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots, self.fresh = np.zeros(0, np.uint64), np.zeros(0, np.int32), {}
        self.ids, self.bounds, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """Ids of new chunks, in the order of their hashes."""
        ids, sizes = self.encode_many(chunks)
        begin, n = self.bounds[self.used], len(chunks)
        while begin + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while self.used + n + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(len(self.bounds), np.int64)])
        self.ids[begin : begin + len(ids)] = ids
        self.bounds[self.used + 1 : self.used + 1 + n] = begin + np.cumsum(sizes)
        self.fresh.update(zip(hashes.tolist(), range(self.used, self.used + n), strict=True))
        self.used += n
        if len(self.fresh) > FRESH:
            keys = np.fromiter(self.fresh.keys(), np.uint64, len(self.fresh))
            slots = np.fromiter(self.fresh.values(), np.int32, len(self.fresh))
            self.keys, self.slots = np.concatenate([self.keys, keys]), np.concatenate([self.slots, slots])
            order = np.argsort(self.keys)
            self.keys, self.slots, self.fresh = self.keys[order], self.slots[order], {}

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each of some sorted hashes; -1 for the unknown."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            out[hit] = self.slots[at[hit]]
        rest = np.flatnonzero(out < 0)
        out[rest] = [self.fresh.get(h, -1) for h in hashes[rest].tolist()]
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for low, high, data, offsets in W.slices(texts):
            if self.used > REMEMBERED:
                self._forget()
            start = self.cuts(data, offsets) if len(data) else np.zeros(0, np.int64)
            end = np.r_[start[1:], len(data)][: len(start)]
            hashes, first, kind = np.unique(W.span_hash(W.byte_sums(data), start, end), return_index=True, return_inverse=True)
            place = self._places(hashes)
            new = np.flatnonzero(place < 0)
            if len(new):
                place[new] = np.arange(self.used, self.used + len(new))
                self._learn(hashes[new], [data[a:b].tobytes().decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            place = place[kind]
            begin = self.bounds[place]
            size = self.bounds[place + 1] - begin
            flat = self.ids[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
            borders = np.r_[0, np.cumsum(size)][np.searchsorted(start, offsets)]
            for i in range(high - low):
                yield flat[borders[i] : borders[i + 1]]

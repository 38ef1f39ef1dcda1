"""Byte-level BPE by tree reduction.

Encoding is a monoid: the ids of a text are made from the ids of its two halves, recursively, and neighbours are joined by
encoding a window around the border anew. Two tokens are *compatible* if encoding their joined bytes gives back just the
two. A sequence whose neighbours are all compatible is the one that rank-ordered merging makes, so a window may stop growing
as soon as it is compatible with the token before and the token after it: nothing outside can change. Decoding concatenates
up the same kind of tree.

A whole text is halved too. At its borders the window is the segment (see ``segments``) that was cut, since matches of the
splitting pattern outside that segment do not depend on it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

from daytrace.llm.common import one_by_one
from daytrace.llm.segments import Unsafe, clean, segments

LEAF_CHARS = 4096
LEAF_BYTES = 3
HEAP_BYTES = 40
KEPT = 100_000
KEPT_LENGTH = 64


class _Kept(dict):
    """Results by key, bounded: once full it becomes the older generation, from which what is asked for again comes back."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.matches = regex.compile(pattern).findall
        self.pairs: dict[int, list[int] | None] = {}
        self.halves = _Kept(self._halved, KEPT // 2)
        self.pieces = _Kept(self._piece)
        self.inner = _Kept(lambda word: self._segment(" " + word) if clean(word) else self._refuse(word))

    @staticmethod
    def _refuse(word: str):
        raise Unsafe(word)

    def merge(self, piece: bytes) -> list[int]:
        """Plain rank-ordered merging of one window."""
        if len(piece) > HEAP_BYTES:
            return self._merge_by_heap(piece)
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_by_heap(self, piece: bytes) -> list[int]:
        """The same, with the mergeable neighbours in a heap: for windows that a periodic text has made wide."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at an index
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            if end[i] < 0 or end[i] >= n or end[end[i]] != stop:  # one of the two parts has changed since
                continue
            end[end[i]], end[i] = -1, stop
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (rank, i, end[stop]))
            if i > 0 and (rank := ranks.get(piece[before[i] : stop])) is not None:
                heappush(heap, (rank, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def again(self, a: int, b: int) -> list[int] | None:
        """The ids of two tokens' joined bytes, or None if the two are compatible."""
        key = a << 32 | b
        if key not in self.pairs:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            ids = self.merge(self.bytes_of[a] + self.bytes_of[b])
            self.pairs[key] = None if ids == [a, b] else ids
        return self.pairs[key]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two neighbouring byte strings put together."""
        if not left or not right:
            return left + right
        window, width = self.again(left[-1], right[0]), 1
        if window is None:
            return left + right
        while True:
            lo, hi = max(len(left) - width, 0), min(width, len(right))
            if width > 1:
                window = self.merge(b"".join([self.bytes_of[i] for i in left[lo:] + right[:hi]]))
            if (lo == 0 or self.again(left[lo - 1], window[0]) is None) and (hi == len(right) or self.again(window[-1], right[hi]) is None):
                return left[:lo] + window + right[hi:]
            width *= 2

    def _halved(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        mid = len(piece) // 2
        return self.join(self.halves[piece[:mid]], self.halves[piece[mid:]])

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        return self._packed([whole] if whole is not None else self._halved(raw))

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}I", *ids)

    def _segment(self, text: str) -> bytes:
        return b"".join([self.pieces[m] for m in self.matches(text)])

    def _leaf(self, text: str) -> tuple[list[str], list[bytes | None]]:
        words = text.split(" ")
        try:
            inner = list(map(self.inner.__getitem__, words[1:-1]))
        except Unsafe:
            inner = None
        if inner is None or not all(clean(w) for w in (words[0], words[-1])):
            words = segments(text)
            inner = [self._segment(" " + w) for w in words[1:-1]]
        return words, [None, *inner, None][: len(words)]

    def _tree(self, text: str) -> tuple[list[str], list[bytes | None]]:
        """Segments and their ids; the first and the last stay open (None) while a neighbour may still change them."""
        if len(text) <= LEAF_CHARS:
            return self._leaf(text)
        mid = len(text) // 2
        (words, ids), (words_r, ids_r) = self._tree(text[:mid]), self._tree(text[mid:])
        window = segments(words.pop() + words_r[0])
        first, last = not words, len(words_r) == 1
        ids.pop()
        ids += [
            None if (first and i == 0) or (last and i == len(window) - 1) else self._segment(" " + w)
            for i, w in enumerate(window)
        ]
        return words + window + words_r[1:], ids + ids_r[1:]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words, ids = self._tree(text)
        for i in {0, len(words) - 1}:
            ids[i] = self._segment(words[i] if i == 0 else " " + words[i])
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        return self._decode(np.frombuffer(ids, "<u4"))

    def _decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self._decode(ids[:mid]) + self._decode(ids[mid:])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}, pattern)


def encode_column(text: Column | str, path: str, pattern: str) -> Column:
    """Token ids of each text as binary, four little-endian bytes an id.

    A null text gives null, an empty one empty bytes. ``path`` names a rank file that every executor can read; the pattern's
    matches are encoded separately, without special tokens.
    """

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for texts in batches:
            yield pa.array((None if t is None else own.encode(t) for t in one_by_one(texts)), pa.binary())

    return encode(F.col(text) if isinstance(text, str) else text)


def coded_column(text: Column | str, path: str, pattern: str) -> Column:
    """A struct of ``ids`` as ``encode_column`` makes them and ``decoded``, the bytes that they give back, from one pass through Python;
    a null text has null fields."""

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for texts in batches:
            ids = [None if t is None else own.encode(t) for t in one_by_one(texts)]
            decoded = pa.array((None if x is None else own.decode(x) for x in ids), pa.binary())
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], ["ids", "decoded"])

    return code(F.col(text) if isinstance(text, str) else text)


def decode_column(ids: Column | str, path: str, pattern: str) -> Column:
    """Bytes of each id sequence made by ``encode_column``; null stays null. An id outside the vocabulary fails the task."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for found in batches:
            yield pa.array((None if x is None else own.decode(x) for x in one_by_one(found)), pa.binary())

    return decode(F.col(ids) if isinstance(ids, str) else ids)

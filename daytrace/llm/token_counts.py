"""Token counts by a public tokenizer library: lengths only, never ids.

Inside an Arrow function texts are cut at safe boundaries (see ``segments``), so a text of any length is the sum of short
pieces; the pieces not counted before are encoded by the library in batches of about ``BATCH_BYTES`` bytes, whether they come
from one long text or from many short ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

from daytrace.llm.common import one_by_one
from daytrace.llm.segments import segments

BATCH_BYTES = 1 << 20
KEPT = 300_000
KEPT_LENGTH = 64


class Counter:
    """Counts tokens with the ``tokenizers`` library. The tokenizer must split like the byte-level pattern."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        known = self.known
        fresh = [p for p in pieces if p not in known]
        if len(known) + len(fresh) > KEPT:
            known.clear()
            fresh = list(pieces)
        batch, size = [], 0
        for piece in fresh:
            batch.append(piece)
            size += len(piece)
            if size >= BATCH_BYTES:
                known.update(zip(batch, self.lengths(batch), strict=True))
                batch, size = [], 0
        known.update(zip(batch, self.lengths(batch), strict=True))

    def count(self, texts: Iterable[str | None]) -> list[int | None]:
        """One count for each text; texts are worked through in groups of about ``BATCH_BYTES`` characters."""
        out: list[int | None] = []
        group: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            pieces: set[str] = set()
            for _, own in group:
                pieces.update(own)
            self._learn(pieces)
            known = self.known
            for at, own in group:
                out[at] += sum(map(known.__getitem__, own))
            for piece in pieces:
                if len(piece) > KEPT_LENGTH:
                    known.pop(piece, None)
            group.clear()

        for text in texts:
            out.append(None if text is None else 0)
            if not text:
                continue
            parts = segments(text)
            own = [parts[0], *[" " + p for p in parts[1:]]]
            if len(text) > BATCH_BYTES:  # a long text is counted in portions
                for lo in range(0, len(own), 1 << 16):
                    group.append((len(out) - 1, own[lo : lo + (1 << 16)]))
                    settle()
                continue
            group.append((len(out) - 1, own))
            size += len(text)
            if size >= BATCH_BYTES:
                settle()
                size = 0
        settle()
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_column(text: Column | str, path: str) -> Column:
    """Number of tokens of each text by the tokenizer file at ``path`` (readable on every executor), without begin, end or
    added special tokens and without truncation; special strings inside a text count as the library's default has it.
    A null text gives null, an empty one 0."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for texts in batches:
            yield pa.array(own.count(one_by_one(texts)), pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)

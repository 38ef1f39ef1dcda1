"""Similarity join on word n-grams: MinHash bands find candidates, full n-gram sets decide.

Texts with the same n-gram set are one class of copies and go on as one row. Band hashes of the classes are shuffled, each
bucket ties its members to its smallest one (never to each other), and the connected parts of that are the only places where
a link can be. A part is cut into blocks of bounded size; each pair of blocks is verified in one task, which counts the links of
each class and hands on one tie for each class that has any. Work inside a task is a product of set matrices, so no pair of
texts is ever written out, and a part of any size is spread over its block pairs.

Candidates are found with the chosen recall for a pair just at the threshold, and better above it; the Jaccard similarity of
what is found is exact (n-grams are compared by 64-bit hashes).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, functions as F

from daytrace.llm.common import join_counted, one_by_one, small_batches
from daytrace.operators.graph import connected_components
from daytrace.session import cut

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
BAND_ROWS = 6
BLOCK_ROWS = 1024
BLOCK_GRAMS = 1_000_000
BROADCAST_ROWS = 2_000_000  # candidate rows (24 bytes each) that may be broadcast; beyond it the join shuffles
KEPT = 100_000
_TOKENS = re.compile(r"\w+").findall


def bands_for(threshold: float, recall: float, rows: int = BAND_ROWS) -> int:
    """Bands of ``rows`` hashes so that a pair at the threshold meets in one of them with at least the wanted chance."""
    return ceil(log(1 - recall) / log(1 - threshold**rows))


class Shingler:
    def __init__(self, words: int):
        self.words = words
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            value = self.known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def grams(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the n-grams; a text of fewer words has one gram of them all, one without words none."""
        own = _TOKENS(text.lower())
        h = np.array([*map(self._hash, own)], np.uint64)
        n = min(self.words, len(h))
        if not n:
            return h
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def _signatures(words: int, bands: int, rows: int):
    rng = np.random.default_rng(11)
    factor = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, np.uint64)
    place = rng.integers(0, 2**63, bands, np.uint64)

    @F.arrow_udf("struct<n: int, grams: binary, buckets: array<bigint>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(words)
        with np.errstate(over="ignore"):
            for texts in batches:
                out = []
                for text in one_by_one(texts):
                    grams = shingler.grams(text)
                    if not len(grams):
                        out.append({"n": 0, "grams": None, "buckets": []})
                        continue
                    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(grams), 1024):
                        np.minimum(low, (grams[at : at + 1024, None] * factor + shift).min(0), out=low)
                    mixed = place.copy()
                    for column in low.reshape(bands, rows).T:
                        mixed = (mixed ^ (column >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                        mixed ^= mixed >> np.uint64(32)
                    out.append({"n": len(grams), "grams": xxhash.xxh3_128_digest(grams.tobytes()), "buckets": mixed.view(np.int64)})
                yield pa.array(out, pa.struct([("n", pa.int32()), ("grams", pa.binary()), ("buckets", pa.list_(pa.int64()))]))

    return sign


def shared_grams(sets: list[np.ndarray]) -> np.ndarray:
    """How many grams each two sets share: frequent grams by a product of 0/1 matrices, rare ones by counting their pairs."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((m, m), np.int32)
    heavy = np.flatnonzero(times > max(m // 16, 2))
    rank = np.full(len(times), -1)
    rank[heavy] = np.arange(len(heavy))
    for lo in range(0, len(heavy), 4096):
        here = (rank[column] >= lo) & (rank[column] < lo + 4096)
        dense = np.zeros((m, min(4096, len(heavy) - lo)), np.float32)
        dense[owner[here], rank[column[here]] - lo] = 1
        shared += (dense @ dense.T).astype(np.int32)
    light = (rank[column] < 0) & (times[column] > 1)
    order = np.argsort(column[light], kind="stable")
    who, count = owner[light][order], times[column[light][order]]
    flat = shared.reshape(-1)
    for c in np.unique(count):
        table = who[count == c].reshape(-1, c)
        for a in range(c):
            for b in range(a + 1, c):
                pairs = np.bincount(table[:, a] * m + table[:, b], minlength=m * m) if len(table) * 8 > m * m else None
                if pairs is None:
                    np.add.at(flat, table[:, a] * m + table[:, b], 1)
                    np.add.at(flat, table[:, b] * m + table[:, a], 1)
                else:
                    shared += pairs.reshape(m, m) + pairs.reshape(m, m).T
    return shared


def verify(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside one block, or between two: key, links (documents), tie (smallest class it reaches over these links, itself counted)."""
    sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
    size = np.array([len(s) for s in sets], float)
    shared = shared_grams(sets)
    # counts are whole numbers, so float64 with a relative slack keeps ties and nothing below them
    linked = shared.astype(np.float64) * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) * (1 - 1e-12)
    np.fill_diagonal(linked, False)
    if group["bi"].iloc[0] != group["bj"].iloc[0]:
        block = group["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    key, weight = group["key"].to_numpy(), group["copies"].to_numpy(float)
    return pd.DataFrame({"key": key, "links": (linked @ weight).astype(np.int64), "tie": _reached(key, linked)})


def _reached(key: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest key that each one reaches, itself counted."""
    order = np.argsort(key)
    near = linked[np.ix_(order, order)]
    root = np.arange(len(key))
    while True:
        low = np.minimum(np.where(near, root[None, :], len(key)).min(1, initial=len(key)), root)
        low = low[low]
        if (low == root).all():
            break
        root = low
    out = np.empty_like(key)
    out[order] = key[order][root]
    return out


def join(
    docs: DataFrame, text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
    block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (a struct of all its columns, untouched), ``key`` (a number of its own), ``class``
    (the smallest key of the documents it is linked with, directly or through others), ``links`` (how many other rows are linked
    with it directly, copies among them) and ``grams`` (size of its n-gram set).

    Copies of one n-gram set are linked with each other. A null text counts as empty; rows without any word are linked with none.
    """
    bands = bands_for(threshold, recall)
    sign = _signatures(words, bands, BAND_ROWS)
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    signed = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")).withColumn("s", sign(text))
    with small_batches(docs.sparkSession):
        seen = Observation()
        signed = signed.select("row", "key", F.col("s.n").alias("n"), F.coalesce("s.grams", F.col("key").cast("string").cast("binary")).alias("grams"), "s.buckets")
        signed = cut(signed.observe(seen, F.count(F.lit(1)).alias("rows")))
    # copies are summed before any other column of theirs moves; their n-gram sets have one size
    classes = cut(signed.groupBy("grams").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")))

    member = signed.select("key", "buckets").join(classes.select("key"), "key", "left_semi").select("key", F.explode("buckets").alias("bucket"))
    first = member.groupBy("bucket").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    near = cut(member.join(first, "bucket").where("key != first").select(F.col("first").alias("i"), F.col("key").alias("j")).distinct())
    part = cut(connected_components(near).select(F.col("id").alias("key"), F.col("component").alias("part")))

    sized = part.join(classes.select("key", "n", "copies"), "key")
    blocks = sized.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n") / block_grams)).cast("int").alias("blocks"))
    placed = cut(sized.join(blocks, "part").select("key", "part", "copies", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")))
    small = placed.limit(broadcast_rows + 1).count() <= broadcast_rows
    shingle = _grams(words)
    chosen = signed.select("key", text.alias("text")).join(F.broadcast(placed) if small else placed, "key")
    chosen = chosen.select("key", "part", "copies", "block", "blocks", shingle("text").alias("grams"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = chosen.withColumn("other", other).select("part", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "key", "copies", "grams")
    dealt = dealt.repartition("part", "bi", "bj").sortWithinPartitions("part", "bi", "bj")

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        place = None
        for pdf in parts:
            for at, group in pdf.groupby(["part", "bi", "bj"], sort=False):
                if at != place and held:
                    yield verify(pd.concat(held), threshold)
                    held = []
                place = at
                held.append(group)
        if held:
            yield verify(pd.concat(held), threshold)

    links = dealt.mapInPandas(check, "key long, links long, tie long").groupBy("key").agg(F.sum("links").alias("links"), F.collect_set("tie").alias("ties"))
    with small_batches(docs.sparkSession):
        checked = cut(links)
    ties = checked.select(F.explode("ties").alias("i"), F.col("key").alias("j")).where("i != j")
    group = connected_components(ties).select(F.col("id").alias("key"), "component")
    found = classes.select("grams", "key", "copies").join(checked.select("key", "links"), "key", "left").join(group, "key", "left")
    found = cut(found.select("grams", "copies", F.coalesce("component", "key").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    out = join_counted(signed.select("row", "key", "n", "grams"), found, ["grams"], "copies", seen.get["rows"])
    return out.select("row", "key", "class", "links", F.col("n").alias("grams"))


def _grams(words: int):
    @F.arrow_udf("binary")
    def shingle(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Shingler(words)
        with np.errstate(over="ignore"):
            for texts in batches:
                yield pa.array((own.grams(t).tobytes() for t in one_by_one(texts)), pa.binary())

    return shingle


def keep_one() -> Column:
    """Whether a row of ``join`` is the one that stays of its class: the first."""
    return F.col("key") == F.col("class")

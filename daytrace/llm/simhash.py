"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has a bit where more than half of its shingles' hashes have it. Two fingerprints that differ by at most two
bits differ, in one half of their bits, by one bit at most; so each half is indexed under every variant with one of its bits left
out, and equal variants bring all links together. A bucket's members are compared in one task. A bucket with too many is dealt
again by the bits that its variant leaves open, which are halved in the same way; at the third level a bucket has eleven open
bits, hence at most 2,048 different fingerprints. Copies of a fingerprint are one row throughout.

Each bucket gives one tie for each member that is linked to a smaller one, directly or through others of the bucket; components
over the ties are those over all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, functions as F

from daytrace.llm.common import join_counted, small_batches
from daytrace.operators.graph import connected_components
from daytrace.session import cut

WORDS = 3
SEED = 42
DISTANCE = 2  # the variants below find links of up to two bits
LEVELS = 3
BUCKET = 2048
BROADCAST_BUCKETS = 500_000  # crowded buckets (24 bytes each) that may be broadcast; beyond it the join shuffles
_SPAN = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64 bits of a UTF-8 text as a signed number: A-Z count as a-z, words end at ASCII white space, shingles of ``words`` words
    are joined by blanks and count as often as they occur; fewer words are one shingle, none give zero."""
    own = text.lower().split()
    if not own:
        return 0
    n = min(words, len(own))
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    many = len(own) - n + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, many, _SPAN):
        hi = min(lo + _SPAN, many)
        places = zip(starts[lo:hi].tolist(), ends[lo + n - 1 : hi + n - 1].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in places], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > many).view(">i8")[0])


def fingerprint_column(text: Column, words: int = WORDS) -> Column:
    @F.arrow_udf("long")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((fingerprint(t.as_py() or b"", words) for t in texts), pa.int64())

    return made(text.cast("string").cast("binary"))


def one_wildcard(start: int, width: int) -> list[tuple[int, int]]:
    """For ``width`` open bits from ``start``: each half's masks with one of its bits left out, and where the other half starts."""
    half = width // 2
    out = []
    for own, rest in ((start, start + half), (start + half, start)):
        for gap in range(half):
            mask = ((1 << half) - 1 ^ 1 << gap) << own
            out.append((mask - (1 << 64) if mask >> 63 else mask, rest))
    return out


def _variants(level: int) -> Column:
    """Masks for rows whose open bits start at ``open``, one row each; a mask fixes what the levels before have fixed, too."""
    width = 64 >> level
    lists = [F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(o).alias("open")) for m, o in one_wildcard(s, width)]) for s in range(0, 64, width)]
    chosen = lists[0]
    for k, masks in enumerate(lists[1:], 1):
        chosen = F.when(F.col("open") == k * width, masks).otherwise(chosen)
    return F.explode(chosen)


def roots(prints: np.ndarray) -> np.ndarray:
    """For each of the fingerprints the place of the first one that it reaches over links among them."""
    own = prints.view(np.uint64)
    linked = np.bitwise_count(own[:, None] ^ own[None, :]) <= DISTANCE
    root = np.arange(len(prints))
    while True:
        low = np.where(linked, root[None, :], len(prints)).min(1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _bucket_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of buckets whose rows (mask, part, fp) lie side by side; a bucket may run on over several batches."""
    held = np.zeros((0, 3), np.int64)

    def ties(groups: list[np.ndarray]) -> pa.RecordBatch:
        i, j = [], []
        for prints in groups:
            root = roots(prints)
            tied = root != np.arange(len(prints))
            i.append(prints[root[tied]])
            j.append(prints[tied])
        both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], ["i", "j"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)])
        edges = [0, *(np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1).tolist()]
        yield ties([rows[a:b, 2].copy() for a, b in pairwise(edges)])
        held = rows[edges[-1] :]
    if len(held):
        yield ties([held[:, 2].copy()])


def links(prints: DataFrame, bucket: int = BUCKET, broadcast_buckets: int = BROADCAST_BUCKETS) -> DataFrame:
    """Ties (i, j) between the distinct fingerprints ``fp``, so that those reachable over ties are those reachable over links."""
    found: list[DataFrame] = []
    rows = prints.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).alias("open"))
    for level in range(LEVELS):
        dealt = rows.select("fp", "mask", _variants(level).alias("v")).withColumn("mask", F.col("mask").bitwiseOR(F.col("v.mask")))
        dealt = dealt.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), F.col("v.open").alias("open"))
        sizes = dealt.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1")
        seen = Observation()
        sizes = cut(sizes.observe(seen, F.count_if(F.col("n") > 2).alias("many"), F.count_if(F.col("n") > bucket).alias("crowded"), F.sum("n").alias("rows")))
        found.append(sizes.where(f"n = 2 and bit_count(low ^ high) <= {DISTANCE}").select(F.col("low").alias("i"), F.col("high").alias("j")))
        many = sizes.where("n > 2").select("mask", "part", "n")
        if not seen.get["many"]:
            break
        if seen.get["many"] <= broadcast_buckets:
            members = dealt.join(F.broadcast(many), ["mask", "part"])
        else:
            members = join_counted(dealt, many, ["mask", "part"], "n", seen.get["rows"])
        last = level == LEVELS - 1
        fit = members if last or not seen.get["crowded"] else members.where(F.col("n") <= bucket)
        fit = fit.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        found.append(fit.mapInArrow(_bucket_ties, "i long, j long"))
        if last or not seen.get["crowded"]:
            break
        rows = cut(members.where(F.col("n") > bucket).select("fp", "mask", "open"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS,
    bucket: int = BUCKET, broadcast_buckets: int = BROADCAST_BUCKETS,
) -> DataFrame:
    """One row for each row of ``docs``: its id under its own name, ``fingerprint`` (a long) and ``component_id``, the smallest id
    reachable from it over fingerprints that differ by at most two bits, its own among them.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other. Rows with equal ids are
    rows of their own; a null id is passed over when the smallest is sought. No other column of ``docs`` is used or returned.
    """
    with small_batches(docs.sparkSession):
        signed = docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(F.col(f"`{text_col}`"), words).alias("fp"))
        seen = Observation()
        signed = cut(signed.observe(seen, F.count(F.lit(1)).alias("rows")))
    total = seen.get["rows"]
    classes = cut(signed.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")))
    ties = links(classes.select("fp"), bucket, broadcast_buckets)
    group = cut(connected_components(ties).select(F.col("id").alias("fp"), "component"))
    joined = group.join(classes, "fp")
    named = joined.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    linked = join_counted(joined.select("fp", "component", "rows"), named, ["component"], "members", total)
    alone = classes.join(group, "fp", "left_anti").select("fp", F.col("first").alias("component_id"), "rows")
    result = cut(linked.select("fp", "component_id", "rows").unionByName(alone))
    out = join_counted(signed, result, ["fp"], "rows", total)
    return out.select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))

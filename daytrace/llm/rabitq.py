"""Nearest neighbours by randomly rotated one-bit codes.

Every vector, less the mean, is turned by a random rotation and kept as the signs of its components together with two
correction scalars: its length, and its inner product with its own code. From the packed signs a search estimates the inner
product with a query and bounds the error (Gao and Long, 2024); only vectors whose upper bound reaches the k-th best lower bound
of their block are scored on the original components.

Queries and vectors go to hashed blocks of bounded size; a block of vectors meets each block of queries once and gives its
best k for each query, and the best k over the blocks are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from daytrace.llm.common import small_batches
from daytrace.session import cut

BLOCK_ROWS = 4096
QUERY_ROWS = 256
GATHER = 16  # pairs are gathered one by one where the bounds leave fewer than one in so many
EPSILON = 3.0  # width of the error bound in standard deviations; at 1.9 about 6 % of the estimates lie outside


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of the unit residuals with their codes."""
    residual = (vectors - centre) @ turn.T
    length = np.linalg.norm(residual, axis=1)
    along = np.abs(residual).sum(1) / np.sqrt(vectors.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(residual > 0, axis=1), length, np.where(length > 0, along, 1.0)


def estimate(codes: np.ndarray, length: np.ndarray, along: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON):
    """Estimated inner products and error bounds, one row a query."""
    d = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    turned = (queries @ turn.T).astype(np.float32)
    guess = (turned @ signs.T) / np.sqrt(d) * (length / along) + (queries @ centre)[:, None]
    error = epsilon * np.sqrt(np.maximum(1 - along**2, 0)) / along / np.sqrt(max(d - 1, 1)) * length
    size = np.linalg.norm(queries, axis=1)[:, None]
    return guess, error * size + 1e-5 * (length + 1) * size


def exact_products(alive: np.ndarray, queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of the pairs marked in ``alive`` for each query, and others that rounding may have kept out: places of query and
    vector, scores.

    Where the bounds leave much of a block, one product of the matrices is cheaper than a gathered pair of vectors for each mark. It
    serves for the choice only: the scores are those of the pairs one by one, so copies tie wherever they lie in a block.
    """
    n = alive.shape[1]
    if n > k and np.count_nonzero(alive) * GATHER > alive.size:
        rough = queries @ vectors.T
        rough[~alive] = -np.inf
        slack = 1e-12 * queries.shape[1] * (np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max() + 1e-300)
        alive = alive & (rough >= (np.partition(rough, n - k, axis=1)[:, n - k] - slack)[:, None])
    q, v = np.nonzero(alive)
    return q, v, np.einsum("ij,ij->i", queries[q], vectors[v])


def best_of_block(block: dict, queries: dict, centre: np.ndarray, turn: np.ndarray, k: int, epsilon: float) -> pd.DataFrame:
    """The best k of one block for each query of another, with exact scores; a row is not its own neighbour."""
    guess, error = estimate(block["codes"], block["length"], block["along"], queries["v"], centre, turn, epsilon)
    other = queries["key"][:, None] != block["key"][None, :]
    n = guess.shape[1]
    least = np.full(len(guess), -np.inf)
    if n > k:
        low = guess - error
        low[~other] = -np.inf
        low.partition(n - k, axis=1)
        least = low[:, n - k]
    q, v, exact = exact_products((guess + error >= least[:, None]) & other, queries["v"], block["v"], k)
    ids = block["id"][v]
    order = np.lexsort((block["key"][v], ids, -exact, q))
    q, v, exact, ids = q[order], v[order], exact[order], ids[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    take = place < k
    return pd.DataFrame({"query_key": queries["key"][q][take], "query_id": queries["id"][q][take], "vec_key": block["key"][v][take], "vec_id": ids[take], "score": exact[take]})


def _packed(rows: DataFrame, n: int, size: int, name: str) -> DataFrame:
    """Rows in hashed blocks of about ``size``, one row a block, as bytes."""
    blocks = max(1, -(-n // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.asarray(x, np.float64) for x in pdf["v"]])
        return pd.DataFrame({name: [int(pdf[name].iloc[0])], f"{name}_key": [pdf["key"].to_numpy(np.int64).tobytes()], f"{name}_id": [pdf["id"].to_numpy(np.int64).tobytes()], f"{name}_v": [v.tobytes()]})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return dealt.groupBy(name).applyInPandas(pack, f"{name} int, {name}_key binary, {name}_id binary, {name}_v binary")


def usable(vec: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, epsilon: float = EPSILON, seed: int = 7,
) -> DataFrame:
    """The ``k`` largest inner products of each query row: query_id, rank, vec_id, score, nearest first, ties to the smaller id.

    Every usable row with an id is indexed and is a candidate of every other row's search, also where ids or vectors repeat;
    fewer candidates give fewer ranks. Rows whose vector has another length than most take no part, as do rows with a null id.
    """
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), vec.alias("v"))
    rows = cut(rows.where(usable(F.col("v")) & F.col("id").isNotNull()))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    top = max(sizes, key=lambda r: (r["n"], -r["d"]))
    d, n, asked = top["d"], top["n"], top["q"]
    rows = rows.where(F.size("v") == d)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d)
        for pdf in parts:
            total += np.stack(pdf["v"].to_list()).sum(0) if len(pdf) else 0
        yield pd.DataFrame({"at": np.arange(d), "s": total})

    centre = np.zeros(d)
    for row in rows.select("v").mapInPandas(sums, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        centre[row["at"]] = row["s"] / n
    turn = rotation(d, seed)
    blocks = max(1, -(-n // block_rows))
    packed = _packed(rows, n, block_rows, "block")

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = [encode(np.frombuffer(v).reshape(-1, d), centre, turn) for v in pdf["block_v"]]
            yield pdf.assign(codes=[c.tobytes() for c, _, _ in made], length=[x.tobytes() for _, x, _ in made], along=[x.tobytes() for _, _, x in made])

    indexed = packed.mapInPandas(index, "block int, block_key binary, block_id binary, block_v binary, codes binary, length binary, along binary")
    asking = _packed(rows.where("asks"), asked, query_rows, "query").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                block = {"key": np.frombuffer(r.block_key, np.int64), "id": np.frombuffer(r.block_id, np.int64), "v": np.frombuffer(r.block_v).reshape(-1, d), "codes": np.frombuffer(r.codes, np.uint8).reshape(-1, -(-d // 8)), "length": np.frombuffer(r.length), "along": np.frombuffer(r.along)}
                query = {"key": np.frombuffer(r.query_key, np.int64), "id": np.frombuffer(r.query_id, np.int64), "v": np.frombuffer(r.query_v).reshape(-1, d)}
                yield best_of_block(block, query, centre, turn, k, epsilon)

    met = asking.join(indexed, "block").mapInPandas(meet, "query_key long, query_id long, vec_key long, vec_id long, score double")
    with small_batches(vectors.sparkSession, 4):  # a row is a pair of blocks
        met = cut(met)
    nearest = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "vec_key")
    return met.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Whitening of vectors by shifted Cholesky QR.

The distinct vectors, in whole numbers and centred exactly, are the rows of a tall matrix. Each pass multiplies the rows, carried
through the triangular solves of the passes before, into one small Gram matrix, whose Cholesky factor is the next triangle. The
first Gram matrix is shifted so that its factor exists however ill-conditioned the rows are (Fukaya et al., 2020); the next passes
make the columns orthonormal to rounding. The product of the triangles is the R of the rows, and its singular vectors and values
are the components and their lengths, without squaring the condition of the rows.

Passes are jobs over the rows: a task sums its own Gram matrix, tasks' sums are added by a grouped job, and only matrices of the
vectors' width come to the driver. No row is written more than once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daytrace.llm.common import arrow_matrix, floored, usual_length, whole_vector
from daytrace.session import cut

SCALE = 64
OFFSET = 1_000_000  # added to every whole number that is returned or compared; it cancels in everything centred
LARGEST = 1 << 31  # magnitude within which whole numbers stay
COMPONENTS = 16
PASSES = 5
_WIDE = 16  # matrix entries summed side by side in one row
_LONG = np.iinfo(np.int64).max


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - sums, in longs where they hold it and in Python's integers beyond."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 61:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(moved: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows of ``centred``; none where a long does not hold it."""
    largest = int(np.abs(moved).max(initial=0))
    if largest**2 * max(moved.shape[1], 1) < 1 << 62:
        return (moved.astype(np.int64) ** 2).sum(1).tolist()
    found = (moved.astype(object) ** 2).sum(1).tolist()
    return [v if v <= _LONG else None for v in found]


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rows times the inverse of the upper triangle ``r``, by substitution column by column."""
    out = np.empty_like(rows)
    for j in range(len(r)):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(rows: DataFrame, d: int, width: int, made: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the columns and of the products of columns of ``made(x)``, a matrix of ``width`` columns."""
    tiles = -(-width // _WIDE)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, tiles * _WIDE))
        for batch in batches:
            m = made(arrow_matrix(batch.column("x"), d))
            total[:width, :width] += m.T @ m
            total[width, :width] += m.sum(0)
        flat = total.reshape(width + 1, tiles, _WIDE).reshape(-1, _WIDE)
        i, tile = np.divmod(np.arange(len(flat)), tiles)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(tile.astype(np.int32)), *[pa.array(c) for c in flat.T]], ["i", "tile", *cells])

    cells = [f"g{k}" for k in range(_WIDE)]
    parts = rows.select("x").mapInArrow(partial, ", ".join(["i int", "tile int", *[f"{c} double" for c in cells]]))
    out = np.zeros((width + 1, tiles * _WIDE))
    for r in parts.groupBy("i", "tile").agg(*[F.sum(c).alias(c) for c in cells]).collect():
        out[r["i"], r["tile"] * _WIDE : (r["tile"] + 1) * _WIDE] = [r[c] for c in cells]
    return out[width, :width], out[:width, :width]


def upper_triangle(g: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """Cholesky factor of a Gram matrix of ``n`` rows, shifted when asked for or when it has none otherwise."""
    d = len(g)
    size = max(np.linalg.norm(g, 2), np.finfo(float).tiny)
    amount = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps * size if shift else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + amount * np.eye(d)).T
        except np.linalg.LinAlgError:
            amount = max(10 * amount, 11 * d * (d + 1) * np.finfo(float).eps * size)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, passes: int = PASSES,
) -> DataFrame:
    """One row for each usable row and component: ``id``, ``component`` (from 1, by falling eigenvalue), ``n`` (distinct vectors),
    ``deviation`` (sum over dimensions of (n*x - S)^2, exact; null beyond a long), ``whitened`` ((x - S/n) on the component over the
    root of its eigenvalue), ``explained`` (its share of the variance) and ``identity_error`` (largest entry of the whitened
    covariance less the identity).

    x is floor(scale * component of the vector) + 1,000,000. Covariances are over the distinct vectors, divided by their number.
    The component's largest entry is positive. Directions without variance to double precision are no components: vectors that are
    all equal give no rows. Rows whose vector is null, empty, or holds null or non-finite entries are left out, as are vectors of
    another length than most. Equal and null ids are rows of their own. Other columns are not used.
    """
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), vec.alias("v")).where(whole_vector(F.col("v")))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d, _ = usual_length(rows, "v")
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = cut(rows.where(F.size("v") == d).select("id", floored(F.col("v"), scale, LARGEST).alias("x")))
    fit = cut(rows.select("x").distinct())

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, np.int64)
        for batch in batches:
            n += batch.num_rows
            sums += arrow_matrix(batch.column("x"), d).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(np.append(sums, n))], ["at", "s"])

    found = fit.mapInArrow(totals, "at long, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by_place = {r["at"]: int(r["s"]) for r in found}
    n, sums = by_place[d], np.array([by_place[i] for i in range(d)], object)
    if n < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    moved = lambda x: centred(x, n, sums).astype(float) / n

    triangles: list[np.ndarray] = []
    for turn in range(passes):
        _, g = gram(fit, d, d, lambda x, now=tuple(triangles): _through(moved(x), now))
        triangles.append(upper_triangle(g, n, shift=turn == 0))
        if turn and np.abs(g - np.eye(d)).max() < 1e-12:
            break
    r = triangles[0]
    for t in triangles[1:]:
        r = t @ r
    _, size, turned = np.linalg.svd(r)
    axes = turned[: min(components, int((size > size[0] * max(d, 16) * 2.0**-50).sum()))]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    k = len(axes)
    root = size[:k] / np.sqrt(n)
    explained = size[:k] ** 2 / (size**2).sum()
    whitened = lambda m: m @ axes.T / root
    mean, g = gram(fit, d, k, lambda x: whitened(moved(x)))
    error = float(np.abs(g / n - np.outer(mean / n, mean / n) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            gap = centred(arrow_matrix(batch.column("x"), d), n, sums)
            w = whitened(gap.astype(float) / n)
            of = np.repeat(np.arange(m), k)
            dev = pa.array(deviations(gap), pa.int64())
            columns = [batch.column("id").take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), dev.take(pa.array(of))]
            columns += [pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def _through(rows: np.ndarray, triangles: tuple[np.ndarray, ...]) -> np.ndarray:
    for t in triangles:
        rows = solved(rows, t)
    return rows


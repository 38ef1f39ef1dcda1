"""Vector expressions on array columns, and the score transforms used around them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from daytrace.functions.common import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def clean(v: Column) -> Column:
    """NaN and infinities → 0, values clipped to ±1e6, in double."""
    def one(x: Column) -> Column:
        d = x.cast("double")
        bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
        return F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.least(d, F.lit(1e6)), F.lit(-1e6)))

    return F.transform(v, one)


def normalize(v: Column) -> Column:
    """Unit length, stored as float; a zero vector stays zero."""
    def scaled(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        return let(F.when(norm == 0, F.lit(1.0)).otherwise(norm), lambda n: F.transform(c, lambda x: (x / n).cast("float")))

    return let(clean(v), scaled)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 − cosine with a small guard in the norms, for centroids that are not unit length."""
    return 1 - dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def score_transform(c: Column, kind: str) -> Column:
    if kind == "none":
        return c.cast("double")
    if kind == "sigmoid":
        return sigmoid(c.cast("double"))
    raise ValueError(f"unsupported score transform: {kind}")


def time_decay(sim: Column, gap: Column, decay: float | None) -> Column:
    return sim * F.exp(-gap / F.lit(float(decay))) if decay else sim


def ramp(cos: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((cos - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def round_to_step(c: Column, step: float = 0.05) -> Column:
    return F.bround(c / step) * step

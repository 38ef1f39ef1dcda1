"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk towards the pooled one and then towards a multiple of the identity; the
score is the logistic of the difference of the two Mahalanobis log densities (plus log priors), computed with the Cholesky
factors kept in the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from daytrace.llm.common import bounded_labels, one_by_one, small_batches, text_or_empty

TRAINING_ROWS = 20_000  # bound of the labelled sample that reaches the driver
SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~"
NAMES = (
    "length", "word_length", "distinct", "repeats", "upper", "symbols", "marks", "pipes", "digits", "other", "lines",
    "same_lines", "common_word", "stops",
)


def statistics(text: str) -> tuple[float, ...]:
    """Transformed statistics of one text, in the order of ``NAMES``; an empty text has those of no words at all."""
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    words = text.split()
    many = max(len(words), 1)
    kinds = Counter(words)
    lines = text.split("\n")
    share = lambda x, of: float(np.log((x + 0.5) / (of + 1.0)))
    letters = int(seen[65:91].sum() + seen[97:123].sum())
    return (
        float(np.log1p(len(words))),
        float(np.log1p(len(text) / many)),
        float(np.log1p(len(kinds)) / np.log1p(many)),
        share(sum(map(eq, words, words[1:])), many),
        share(int(seen[65:91].sum()), max(letters, 1)),
        share(int(seen[list(SYMBOLS)].sum()), n),
        share(int(seen[33] + seen[63]), n),
        share(int(seen[124]), n),
        share(int(seen[48:58].sum()), n),
        share(int(seen[128:].sum()), n),
        share(len(lines), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(max(kinds.values(), default=0), many),
        share(int(seen[46]), n),
    )


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # Cholesky factors of the class covariances
    offsets: list[float]  # log prior less half the log determinant

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        z = np.clip((rows - self.centre) / self.scale, -12, 12)
        log = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            u = np.linalg.solve(factor, (z - mean).T)
            log.append(offset - 0.5 * (u * u).sum(0))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(rows: np.ndarray, y: np.ndarray, towards_pooled: float = 0.1, towards_identity: float = 0.05) -> Discriminant:
    """With rows of one class only, or none, both classes get the pooled (or unit) Gaussian and the prior decides."""
    d = len(NAMES)
    rows = rows.reshape(-1, d)
    centre = rows.mean(0) if len(rows) else np.zeros(d)
    scale = np.maximum(rows.std(0), 1e-3) if len(rows) else np.ones(d)
    z = np.clip((rows - centre) / scale, -12, 12)
    parts = [z[y == k] for k in (0, 1)]
    means = [p.mean(0) if len(p) else np.zeros(d) for p in parts]
    spread = [(p - m).T @ (p - m) if len(p) else np.zeros((d, d)) for p, m in zip(parts, means, strict=True)]
    pooled = sum(spread) / max(len(z), 1) if len(z) > 1 else np.eye(d)
    factors, offsets = [], []
    for p, s in zip(parts, spread, strict=True):
        own = s / len(p) if len(p) > 1 else pooled
        cov = (1 - towards_pooled) * own + towards_pooled * pooled
        cov = (1 - towards_identity) * cov + towards_identity * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        factors.append(factor)
        offsets.append(float(np.log((len(p) + 1) / (len(z) + 2)) - np.log(np.diag(factor)).sum()))
    return Discriminant(centre, scale, means, factors, offsets)


def statistics_column(text: Column | str) -> Column:
    @F.arrow_udf("array<double>")
    def take(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([statistics(t or "") for t in one_by_one(texts)], pa.list_(pa.float64()))

    return take(F.col(text) if isinstance(text, str) else text)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = TRAINING_ROWS) -> Discriminant:
    """Fit on at most about ``bound`` labelled rows; pass only the labels that may be learned from. Labels without a document
    and documents without a label take no part; a null text counts as empty."""
    chosen = bounded_labels(labels, label, bound, id_col)
    found = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("t")).join(F.broadcast(chosen), "id")
    with small_batches(docs.sparkSession):
        got = found.select("y", statistics_column("t").alias("x")).toPandas()
    return fit(np.array(got["x"].tolist(), float), got["y"].to_numpy())


def score_column(text: Column | str, model: Discriminant) -> Column:
    """Probability that a text deserves label 1, from 0 to 1; null and empty texts are scored as empty."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([statistics(t or "") for t in one_by_one(texts)], float).reshape(-1, len(NAMES))
            yield pa.array(model.score(rows), pa.float64())

    return score(F.col(text) if isinstance(text, str) else text)

"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a table of word stems (first four to nine characters) that a bounded sample of labelled texts shows to be
typical of toxic ones, joined with a few fixed English words. Features are densities of lexicon words (plain, and behind
look-alike characters or inserted marks), their nearness to second-person words, capitals, punctuation and mixed tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from daytrace.llm.common import bounded_labels, one_by_one, small_batches, text_or_empty

TRAINING_ROWS = 20_000  # bound of the labelled sample that reaches the driver
LEXICON_SIZE = 400  # bound of the learned lexicon
# Fixed word lists.
SEEDS = "idiot moron stupid pathetic loser trash scum worthless disgusting clown".split()
SECOND_PERSON = frozenset("you your yours u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
HIT, HIDDEN, PERSON, MIXED = 1, 2, 4, 8
NEAR = 6
SHORTEST, LONGEST = 4, 9  # stem lengths
KEPT = 100_000
NAMES = ("hits", "log_hits", "hidden", "near", "persons", "mixed", "upper", "exclaim", "question", "marks", "densest", "length")


def stems(word: str) -> tuple[str, ...]:
    return tuple(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)) or (word,)


class Reader:
    """Turns texts into feature rows; what a word means is kept, up to ``KEPT`` words."""

    def __init__(self, lexicon: frozenset[str]):
        self.lexicon = lexicon
        self.kinds: dict[str, int] = {}

    def kind(self, word: str) -> int:
        known = self.kinds.get(word)
        if known is None:
            bare = word.strip(MARKS)
            plain = bare.translate(LOOKALIKES)
            plain = "".join(c for c in plain if c.isalnum())
            hit = bool(bare) and any(s in self.lexicon for s in stems(bare))
            hidden = not hit and plain != bare and any(s in self.lexicon for s in stems(plain))
            mixed = bool(bare) and not bare.isalpha() and any(map(str.isalpha, bare))
            known = HIT * hit | HIDDEN * hidden | PERSON * (bare in SECOND_PERSON) | MIXED * mixed
            if len(self.kinds) >= KEPT:
                self.kinds.clear()
            if len(word) <= 64:
                self.kinds[word] = known
        return known

    def features(self, text: str) -> tuple[float, ...]:
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        letters, n = max(int(raw[65:91].sum() + raw[97:123].sum()), 1), max(int(raw.sum()), 1)
        words = text.lower().split()
        flags = np.array([*map(self.kind, words)], np.uint8)
        many = max(len(words), 1)
        bad = np.flatnonzero(flags & (HIT | HIDDEN))
        near = densest = 0.0
        if len(bad):
            persons = np.flatnonzero(flags & PERSON)
            if len(persons):
                at = np.searchsorted(persons, bad)
                gap = np.minimum(np.abs(persons[np.minimum(at, len(persons) - 1)] - bad), np.abs(persons[np.maximum(at - 1, 0)] - bad))
                near = float((gap <= NEAR).mean())
            densest = float((np.searchsorted(bad, bad + 50) - np.arange(len(bad))).max())
        count = lambda flag: int(np.count_nonzero(flags & flag))
        marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
        return (
            len(bad) / many, float(np.log1p(len(bad))), count(HIDDEN) / many, near, count(PERSON) / many, count(MIXED) / many,
            int(raw[65:91].sum()) / letters, int(raw[33]) / n, int(raw[63]) / n, marks / n, densest, float(np.log1p(len(words))),
        )

    def rows(self, texts) -> np.ndarray:
        return np.array([self.features(t or "") for t in texts], float).reshape(-1, len(NAMES))


@dataclass
class Boosted:
    """Trees as rows (feature, threshold, left, right, value): feature -1 marks a leaf."""

    base: float = 0.0
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        for tree in self.trees:
            todo = [(0, np.arange(len(rows)))]
            while todo:
                at, own = todo.pop()
                column, cut, left, right, value = tree[at]
                if column < 0:
                    out[own] += value
                    continue
                low = rows[own, column] <= cut
                todo += [(left, own[low]), (right, own[~low])]
        return out


def boost(rows: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 48, ridge: float = 1.0) -> Boosted:
    """Logistic boosting with second-order splits on binned features."""
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Boosted(float(np.log(prior / (1 - prior))))
    if not 0 < y.sum() < len(y):
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in rows.T]
    binned = [np.searchsorted(c, col, side="left") for c, col in zip(cuts, rows.T, strict=True)]
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        tree: list[tuple[int, float, int, int, float]] = []

        def grow(own: np.ndarray, level: int, tree=tree, g=g, h=h) -> int:
            at = len(tree)
            total_g, total_h = g[own].sum(), h[own].sum()
            value = -rate * total_g / (total_h + ridge)
            tree.append((-1, 0.0, 0, 0, value))
            best = (1e-6, -1, 0)
            if level < depth and len(own) >= 20:
                for k, col in enumerate(binned):
                    if not len(cuts[k]):
                        continue
                    size = len(cuts[k]) + 1
                    left_g = np.cumsum(np.bincount(col[own], g[own], size))[:-1]
                    left_h = np.cumsum(np.bincount(col[own], h[own], size))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], k, j)
            if best[1] >= 0:
                low = binned[best[1]][own] <= best[2]
                left, right = grow(own[low], level + 1), grow(own[~low], level + 1)
                tree[at] = (best[1], float(cuts[best[1]][best[2]]), left, right, 0.0)
            else:
                margin[own] += value
            return at

        grow(np.arange(len(y)), 0)
        model.trees.append(tree)
    return model


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the best rising step function, ties in ``x`` pooled first."""
    if not len(x):
        return np.zeros(1), np.full(1, 0.5)
    knots, where = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # sum, weight, first knot, last knot
    for k, (s, w) in zip(knots, zip(np.bincount(where, y), np.bincount(where), strict=True), strict=True):
        blocks.append([s, w, k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], last]
    return (
        np.array([b[i] for b in blocks for i in (2, 3)], float),
        np.array([b[0] / b[1] for b in blocks for _ in (2, 3)], float),
    )


@dataclass
class Toxicity:
    lexicon: frozenset[str]
    boosted: Boosted
    knots: np.ndarray
    values: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.boosted.margin(rows), self.knots, self.values), 0, 1)


def learn_lexicon(found: DataFrame, size: int = LEXICON_SIZE) -> frozenset[str]:
    """Stems of the sample ``found(t, y)`` that stand in at least 1 % of the toxic texts (three at least) and whose texts are
    almost all toxic, the most frequent ``size`` of them."""
    totals = found.agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
    positive, negative = totals["p"] or 0, (totals["n"] or 0) - (totals["p"] or 0)
    words = F.array_distinct(F.filter(F.split(F.lower("t"), r"[^\p{L}]+"), lambda w: F.length(w) >= SHORTEST))
    lengths = lambda w: F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length(w)))
    both = F.flatten(F.transform(words, lambda w: F.transform(lengths(w), lambda k: F.substr(w, F.lit(1), k))))
    seen = found.select("y", F.explode(F.array_distinct(both)).alias("stem")).groupBy("stem")
    seen = seen.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    enough = max(3, 0.01 * positive)
    typical = F.col("n") / max(negative, 1) <= 0.01 * F.col("p") / max(positive, 1)
    top = seen.where((F.col("p") >= enough) & typical).orderBy(F.desc("p"), "stem").limit(size)
    return frozenset(r["stem"] for r in top.collect()) | {s for w in SEEDS for s in stems(w)[-1:]}


def fit(lexicon: frozenset[str], rows: np.ndarray, y: np.ndarray, folds: int = 3) -> Toxicity:
    """Trees on all rows; the calibration is learned on margins of trees that have not seen the row."""
    fold = np.arange(len(y)) % folds
    outside = np.zeros(len(y))
    for k in range(folds):
        outside[fold == k] = boost(rows[fold != k], y[fold != k]).margin(rows[fold == k])
    knots, values = isotonic(outside, y)
    return Toxicity(lexicon, boost(rows, y), knots, values)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = TRAINING_ROWS) -> Toxicity:
    """Fit on at most about ``bound`` labelled rows; pass only the labels that may be learned from. Labels without a document
    and documents without a label take no part; a null text counts as empty. Without labels every score is 0.5."""
    chosen = bounded_labels(labels, label, bound, id_col)
    found = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("t")).join(F.broadcast(chosen), "id")
    lexicon = learn_lexicon(found)

    @F.arrow_udf("array<double>")
    def take(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(lexicon)
        for texts in batches:
            yield pa.array(reader.rows(one_by_one(texts)).tolist(), pa.list_(pa.float64()))

    with small_batches(docs.sparkSession):
        got = found.select("id", "y", take("t").alias("x")).toPandas().sort_values("id", kind="stable")
    return fit(lexicon, np.array(got["x"].tolist(), float).reshape(-1, len(NAMES)), got["y"].to_numpy())


def score_column(text: Column | str, model: Toxicity) -> Column:
    """Calibrated probability that a text is toxic, from 0 to 1; null and empty texts are scored as empty."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(model.lexicon)
        for texts in batches:
            yield pa.array(model.score(reader.rows(one_by_one(texts))), pa.float64())

    return score(F.col(text) if isinstance(text, str) else text)

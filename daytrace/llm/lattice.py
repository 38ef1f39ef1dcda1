"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary span a lattice over each word; its probability is the sum over all ways to cut it into
pieces, by a forward recursion in log space. A word seen in training is one more arc over the whole word. The vocabulary's own
scores are the prior of the piece weights (they rank the pieces; the weight falls with the rank). The weights of pieces and word
arcs come out of the same expectation steps over all training tokens: a token uses its word's arc or the pieces, in proportion
to what each explains; an arc keeps its expected uses less a discount (from the counts of rare words), and all other tokens are dealt to the pieces by
forward and backward sums. A text is its words, each begun by a word mark, and one end; pieces of single bytes make every text
possible. The score is the log of the marginal over all segmentations, word arcs included.

Word counts are summed in Spark. Lattices of words of one length go through a trie of the pieces together, as arrays. The most
frequent words (a fixed number) are broadcast to the scoring tasks, and all other words of a text meet the word table in a join.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from daytrace.session import cut

COMMON_WORDS = 100_000  # bound of the broadcast part of the word table
PRIOR_PIECES = 5_000.0  # weight of the vocabulary's prior, as a number of pieces
DISCOUNT = 0.75  # where the corpus has no word that occurs once
STEPS = 4  # expectation steps at most; fewer once the training sum settles
SETTLED = 1e-3  # relative change of the training sum
TOGETHER = 20_000  # words of a task that are looked at together
CELLS = 2_000_000  # arcs of words of one length that are held as arrays together
FLUSH = 200_000
MARK = b" "
KEPT_ARCS = 512  # bytes; the arcs of a longer word are looked up again when they are needed, not kept


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[bytes, float], ...]:
    """Pieces as bytes with prior weights: normal pieces by rank of their score, and every single byte."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=path)
    scored: dict[bytes, float] = {}
    for i in range(own.get_piece_size()):
        if own.is_unknown(i) or own.is_control(i) or own.is_byte(i) or own.is_unused(i):
            continue
        piece = own.id_to_piece(i).replace("▁", " ").encode()
        if piece.lower() == piece and MARK not in piece[1:]:
            scored[piece] = max(scored.get(piece, -np.inf), own.get_score(i))
    ordered = sorted(scored, key=lambda p: (-scored[p], p))
    weights = {p: 1.0 / (k + 10) for k, p in enumerate(ordered)}
    for b in range(256):
        weights.setdefault(bytes([b]), 0.1 / (len(ordered) + 10))
    total = sum(weights.values())
    return tuple((p, w / total) for p, w in weights.items())


class Lattice:
    """Log weights of pieces, and sums over the segmentations of a word."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.log = {p: log(w) for p, w in zip(pieces, weights.tolist(), strict=True)}
        self.longest = max(map(len, pieces))
        self.index = {p: i for i, p in enumerate(pieces)}
        self.weight = np.append(np.log(weights), -np.inf)  # the last one is that of no piece
        self._trie: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None

    def _reaching(self, text: bytes, end: int) -> list[tuple[int, float, bytes]]:
        """The arcs that reach ``end``: start, log weight, piece."""
        get, own = self.log.get, []
        for start in range(max(0, end - self.longest), end):
            weight = get(text[start:end])
            if weight is not None:
                own.append((start, weight, text[start:end]))
        return own

    def arcs(self, text: bytes):
        """For each end but 0, the arcs that reach it; to be gone through in any direction."""
        if len(text) <= KEPT_ARCS:
            kept = [self._reaching(text, end) for end in range(1, len(text) + 1)]
            return lambda end: kept[end - 1]
        return lambda end: self._reaching(text, end)

    @staticmethod
    def _forward(arcs, size: int) -> array:
        ahead = array("d", [0.0])
        for end in range(1, size + 1):
            terms = [ahead[start] + weight for start, weight, _ in arcs(end)]
            top = max(terms)
            ahead.append(top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms])))
        return ahead

    def log_probability(self, word: bytes) -> float:
        """Natural log of the marginal probability of the mark and the word, over all segmentations of the whole word."""
        text = MARK + word
        return self._forward(lambda end: self._reaching(text, end), len(text))[-1]

    def expected(self, word: bytes, times: float, into: np.ndarray) -> None:
        """Adds ``times`` the expected number of uses of each piece."""
        text = MARK + word
        arcs = self.arcs(text)
        ahead = self._forward(arcs, len(text))
        behind = array("d", bytes(8 * len(ahead)))
        behind[-1] = times
        for end in range(len(text), 0, -1):  # behind: expected visits of a node
            visits = behind[end]
            for start, weight, piece in arcs(end):
                used = visits * exp(ahead[start] + weight - ahead[end])
                behind[start] += used
                into[self.index[piece]] += used

    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First nodes by byte, column of each later byte, next node by node and column, piece that ends at a node (or -1).
        Node 0 is no node."""
        if self._trie is None:
            later = sorted({b for p in self.index for b in p[1:]})
            column = np.zeros(256, np.int64)
            column[later] = np.arange(1, len(later) + 1)
            nodes: dict[bytes, int] = {}
            for piece in self.index:
                for end in range(1, len(piece) + 1):
                    nodes.setdefault(piece[:end], len(nodes) + 1)
            first = np.zeros(256, np.int32)
            following = np.zeros((len(nodes) + 1, len(later) + 1), np.int32)
            ends = np.full(len(nodes) + 1, -1, np.int32)
            for prefix, node in nodes.items():
                if len(prefix) == 1:
                    first[prefix[0]] = node
                else:
                    following[nodes[prefix[:-1]], column[prefix[-1]]] = node
                ends[node] = self.index.get(prefix, -1)
            self._trie = first, column, following, ends
        return self._trie

    def _arc_ids(self, texts: np.ndarray) -> np.ndarray:
        """Pieces by text, end - 1 and length - 1 (-1: none), for texts of one length, one a row."""
        first, column, following, ends = self.trie()
        n, size = texts.shape
        ids = np.full((n, size, min(self.longest, size)), -1, np.int32)
        row, start = (a.ravel() for a in np.indices((n, size)))
        node = first[texts.ravel()]
        depth = 0
        while True:
            alive = node > 0
            row, start, node = row[alive], start[alive], node[alive]
            if not len(node):
                return ids
            ids[row, start + depth, depth] = ends[node]
            depth += 1
            inside = start + depth < size
            row, start, node = row[inside], start[inside], node[inside]
            node = following[node, column[texts[row, start + depth]]]

    def _sums(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log weights of the arcs, and log forward sums of each node, for texts of one length."""
        n, size, longest = ids.shape
        weight = self.weight[ids]
        ahead = np.zeros((n, size + 1))
        for end in range(1, size + 1):
            most = min(longest, end)
            terms = ahead[:, end - most : end][:, ::-1] + weight[:, end - 1, :most]
            top = terms.max(axis=1)
            ahead[:, end] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
        return weight, ahead

    def _alike(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray | None]]:
        """Positions of words of one length, as many as fit, with their texts as rows; longer words one by one, without."""
        by_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_size.setdefault(len(word) + 1, []).append(k)
        for size, own in by_size.items():
            if size > KEPT_ARCS:
                yield from (([k], None) for k in own)
                continue
            step = max(1, CELLS // (size * min(self.longest, size)))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                flat = b"".join([MARK + words[k] for k in part])
                yield part, np.frombuffer(flat, np.uint8).reshape(len(part), size)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """``log_probability`` of each word."""
        out = np.empty(len(words))
        for part, texts in self._alike(words):
            out[part] = self.log_probability(words[part[0]]) if texts is None else self._sums(self._arc_ids(texts))[1][:, -1]
        return out

    def expected_uses(self, words: list[bytes], times: Callable[[list[int], np.ndarray], np.ndarray], into: np.ndarray) -> None:
        """``expected`` of each word; ``times`` gets positions of words and their log probabilities."""
        for part, texts in self._alike(words):
            if texts is None:
                word = words[part[0]]
                self.expected(word, float(times(part, np.array([self.log_probability(word)]))[0]), into)
                continue
            ids = self._arc_ids(texts)
            weight, ahead = self._sums(ids)
            n, size, longest = ids.shape
            behind = np.zeros((n, size + 1))  # expected visits of a node
            behind[:, -1] = times(part, ahead[:, -1])
            for end in range(size, 0, -1):
                most = min(longest, end)
                arc = weight[:, end - 1, :most]
                arc[...] = behind[:, end, None] * np.exp(ahead[:, end - most : end][:, ::-1] + arc - ahead[:, end, None])
                behind[:, end - most : end] += arc[:, ::-1]
            found = ids >= 0
            into += np.bincount(ids[found], weights=weight[found], minlength=len(into))


def words_of(text: str) -> list[bytes]:
    """Words: runs of bytes other than space and the five controls from tab to return, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, text_col: str, learn: Column) -> DataFrame:
    """Every distinct word of ``docs`` with its count ``c`` in the rows that may be learned from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        held: set[bytes] = set()

        def flush():
            held.difference_update(seen)
            words = [*seen, *held]
            counts = [*seen.values(), *([0] * len(held))]
            seen.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "c"])

        for batch in batches:
            for text, use in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (seen if use else held).update(words_of(text or ""))
                if len(seen) + len(held) > FLUSH:
                    yield flush()
        yield flush()

    parts = docs.select(F.col(f"`{text_col}`"), learn.alias("use")).mapInArrow(count, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def discount_of(once: int, twice: int) -> float:
    """What a count is too high by when it foretells other texts, from the numbers of words that occur once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else DISCOUNT


def own_uses(counts: np.ndarray, log_chance: np.ndarray, spread: float, known: int, discount: float) -> np.ndarray:
    """Uses of a word's own arc: the larger solution of a = count * a / (a + x) - discount, x the uses the pieces foretell, which
    is where expectation steps for this word would settle; 0 where there is none, as then the pieces explain the word."""
    foretold = np.exp(log_chance) * (spread * known)
    half = counts - discount - foretold
    inner = half * half - 4 * discount * foretold
    return np.where((half > 0) & (inner >= 0), (half + np.sqrt(np.maximum(inner, 0))) / 2, 0.0)


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and counts of several batches at a time."""
    words: list[bytes] = []
    counts: list[int] = []
    for batch in batches:
        words += batch.column(0).to_pylist()
        counts += batch.column(1).to_pylist()
        if len(words) >= TOGETHER:
            yield words, np.array(counts, float)
            words, counts = [], []
    if words:
        yield words, np.array(counts, float)


def train(words: DataFrame, pieces: list[bytes], prior: np.ndarray, known: int, kinds: int, discount: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Piece weights and the share of tokens left to pieces, after expectation steps over all training tokens from the
    vocabulary's ``prior``, which stays mixed in. The word table is read once a step; sums by piece come back."""
    weights, spread, before = prior, (discount * kinds / known if known else 1.0), None
    seen = words.where("c > 0")
    for _ in range(steps if known else 0):

        def expect(batches: Iterator[pa.RecordBatch], weights=weights, spread=spread) -> Iterator[pa.RecordBatch]:
            lattice, sums = Lattice(pieces, weights), np.zeros(len(pieces))
            uses, total = 0.0, 0.0
            for own_words, counts in together(batches):

                def left(part: list[int], chance: np.ndarray) -> np.ndarray:
                    nonlocal uses, total
                    own = own_uses(counts[part], chance, spread, known, discount)
                    uses += float(own.sum())
                    total += float((counts[part] * np.where(own > 0, np.log(own / known + np.exp(chance) * spread + 1e-300), chance + log(spread))).sum())
                    return counts[part] - own

                lattice.expected_uses(own_words, left, sums)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([*used, -1, -2], pa.int32()), pa.array([*sums[used], uses, total], pa.float64())], ["piece", "e"])

        sums = prior * PRIOR_PIECES
        now, uses = 0.0, 0.0
        parts = seen.select("word", "c").mapInArrow(expect, "piece int, e double")
        for row in parts.groupBy("piece").agg(F.sum("e").alias("e")).collect():  # at most two rows more than there are pieces
            if row["piece"] >= 0:
                sums[row["piece"]] += row["e"]
            elif row["piece"] == -1:
                uses = row["e"]
            else:
                now = row["e"]
        weights, spread = sums / sums.sum(), 1 - uses / known
        if before is not None and abs(now - before) <= SETTLED * abs(before):
            break
        before = now
    return weights, spread


def word_scores(words: DataFrame, pieces: list[bytes], weights: np.ndarray, spread: float, known: int, kinds: int, ends: int, discount: float) -> DataFrame:
    """Adds to the word table the base score and the model's log10 probability of each word."""
    total, base_sum = known + ends, log10(known + ends + 0.1 * (kinds + (ends > 0) + 1))
    stay = log10(1 - (ends + 1) / (total + 2))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, weights)
        for own_words, counts in together(batches):
            chance = lattice.log_probabilities(own_words)
            own = own_uses(counts, chance, spread, known, discount)
            yield pa.RecordBatch.from_arrays([pa.array(own_words, pa.binary()), pa.array(counts.astype(np.int64)), pa.array(chance), pa.array(own)], ["word", "c", "chance", "own"])

    found = cut(words.select("word", "c").mapInArrow(add, "word binary, c long, chance double, own double"))
    uses = found.agg(F.coalesce(F.sum("own"), F.lit(0.0))).first()[0]
    rest = 1 - uses / known if known else 1.0  # what the arcs of words leave, so that all words sum to one at most
    pieces_only = F.col("chance") / log(10) + log10(rest)
    with_arc = F.log10(F.col("own") / max(known, 1) + F.exp("chance") * rest)
    return found.select(
        "word", "c", (F.log10(F.col("c") + 0.1) - base_sum).alias("base"),
        (F.when(F.col("own") > 0, with_arc).otherwise(pieces_only) + stay).alias("score"),
    )


def common_words(scored: DataFrame, most: int) -> dict[bytes, tuple[bool, float, float]]:
    """The words whose count reaches a power of two, the smallest power that at most ``most`` words reach."""
    sizes = scored.where("c > 0").groupBy(F.floor(F.log2("c")).cast("int").alias("power")).count().collect()
    total, power = 0, None
    for row in sorted(sizes, key=lambda r: -r["power"]):
        total += row["count"]
        if total > most:
            break
        power = row["power"]
    if power is None:
        return {}
    got = scored.where(F.col("c") >= (1 << power)).toPandas()
    return {bytes(w): (True, b, s) for w, b, s in zip(got["word"], got["base"], got["score"], strict=True)}


def score(docs: DataFrame, learn: Column, path: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON_WORDS) -> DataFrame:
    """One row for each row of ``docs``: id, learned (whether it was learned from), n_tokens, n_known, train_tokens,
    base_score, score (both log10).

    ``learn`` marks the rows to learn from; where it is null the row is not learned from. A null text is an empty one, which
    has the end as its only token. Rows keep their own result even where ids are null or repeat; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").alias("id"), F.coalesce(learn, F.lit(False)).alias("use"), F.col(f"`{text_col}`").alias("text"))
    words = cut(word_counts(rows, "text", F.col("use")))
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    ends = rows.where("use").count()
    known, kinds, total = sums["n"], sums["v"], sums["n"] + ends
    discount = discount_of(sums["once"], sums["twice"])
    vocab = vocabulary(path)
    pieces = [p for p, _ in vocab]
    weights, spread = train(words, pieces, np.array([w for _, w in vocab]), known, kinds, discount)
    scored = word_scores(words, pieces, weights, spread, known, kinds, ends, discount)
    shared = docs.sparkSession.sparkContext.broadcast(common_words(scored, common))
    end_base = log10((ends + 0.1) / (total + 0.1 * (kinds + (ends > 0) + 1)))
    end_score = log10((ends + 1) / (total + 2))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            out = []
            for text in batch.column(3).to_pylist():
                own = words_of(text or "")
                known_n, base, chance, rest = int(ends > 0), end_base, end_score, []
                for word, n in Counter(own).items():
                    found = get(word)
                    if found is None:
                        rest.append({"word": word, "n": n})
                    else:
                        known_n += n
                        base += n * found[1]
                        chance += n * found[2]
                out.append({"n_tokens": len(own) + 1, "n_known": known_n, "base_score": base, "score": chance, "rest": rest})
            made = pa.Table.from_pylist(out, schema=pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))]))
            for part in made.to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *part.columns], ["key", "id", "learned", *part.schema.names])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"key long, id {id_type}, learned boolean, n_tokens long, n_known long, base_score double, score double, rest array<struct<word: binary, n: int>>"
    partial = cut(rows.mapInArrow(settle, schema))
    rest = partial.select("key", F.explode("rest").alias("r")).select("key", "r.word", "r.n").join(scored, "word").groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.col("base")).alias("more_base"), F.sum(F.col("n") * F.col("score")).alias("more")
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return partial.drop("rest").join(rest, "key", "left").select(
        F.col("id").alias(id_col), "learned", "n_tokens", plus("n_known", "more_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base_score", "more_base"), plus("score", "more"),
    )

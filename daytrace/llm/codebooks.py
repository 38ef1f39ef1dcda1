"""Compression of vectors to codes: each part of a vector becomes the number of its nearest codebook entry.

Codebooks are trained by rounds of assignment and averaging in whole numbers. Assignments after the first look at as few entries
as the bounds of Drake and Hamerly (2012) allow: with each part are kept its entry and an upper bound of the distance to it, the
``b`` entries that were closest, with lower bounds in order, and one outer bound for all the rest. When the entries move, the
bounds move by as much. Entries whose lower bound stays above the upper bound need no look; a part whose outer bound fails is
compared with all entries. Bounds are floats rounded to the safe side and decide only what is strictly apart; everything else is
decided by distances in whole numbers, ties by the lower entry, so the codes are those of a full search.

Each round reads the rows, writes them with their new bounds, and sums the parts by entry in a grouped job; only the codebooks and
the counts that set the next ``b`` come to the driver, and their size does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from daytrace.llm.common import arrow_matrix, floored, usual_length, whole_vector
from daytrace.session import cut

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 1 << 26  # components stay within this magnitude, less for very long parts, so that a squared distance is a long
LISTED = (4, 16, 64)  # least, first and most entries listed with a part
WIDE = 16  # components summed side by side in one row
BROADCAST_LABELS = 1_000_000
SALT = 16
_NONE = 0xFFFF  # a place in the list without an entry
_TASK_ROWS = 2048  # rows compared with all entries at once


def _below(x: np.ndarray) -> np.ndarray:
    x = x * (1 - 1e-9)
    f = x.astype(np.float32)
    return np.where(f > x, np.nextafter(f, np.float32(-np.inf)), f).astype(np.float32)


def _above(x: np.ndarray) -> np.ndarray:
    x = x * (1 + 1e-9)
    f = x.astype(np.float32)
    return np.where(f < x, np.nextafter(f, np.float32(np.inf)), f).astype(np.float32)


class Bounds:
    """What is kept with the same part of several vectors: entry and upper bound, listed entries with lower bounds, outer bound."""

    def __init__(self, entry, upper, listed, lower, outer):
        self.entry, self.upper, self.listed, self.lower, self.outer = entry, upper, listed, lower, outer

    @staticmethod
    def width(b: int) -> int:
        return 2 + 4 + 6 * b + 4

    def pack(self) -> np.ndarray:
        n = len(self.entry)
        fields = [(self.entry, np.uint16), (self.upper, np.float32), (self.listed, np.uint16), (self.lower, np.float32), (self.outer, np.float32)]
        return np.concatenate([np.ascontiguousarray(v.reshape(n, -1), t).view(np.uint8).reshape(n, -1) for v, t in fields], axis=1)

    @classmethod
    def unpack(cls, raw: np.ndarray, b: int) -> Bounds:
        edges = np.cumsum([2, 4, 2 * b, 4 * b, 4])[:-1]
        entry, upper, listed, lower, outer = [np.ascontiguousarray(x) for x in np.split(raw, edges, axis=1)]
        n = len(raw)
        as_list = lambda x, t: x.view(t).reshape(n, b) if b else np.zeros((n, 0), t)
        return cls(entry.view(np.uint16)[:, 0], upper.view(np.float32)[:, 0], as_list(listed, np.uint16), as_list(lower, np.float32), outer.view(np.float32)[:, 0])

    def resized(self, b: int) -> Bounds:
        """With ``b`` places: the outer bound takes over what is cut off; new places are empty."""
        n, now = self.listed.shape
        if b < now:
            gone = np.where(self.listed[:, b:] == _NONE, np.inf, self.lower[:, b:]).min(1)
            return Bounds(self.entry, self.upper, self.listed[:, :b], self.lower[:, :b], np.minimum(self.outer, gone).astype(np.float32))
        more = np.full((n, b - now), _NONE, np.uint16)
        return Bounds(self.entry, self.upper, np.hstack([self.listed, more]), np.hstack([self.lower, np.full(more.shape, np.inf, np.float32)]), self.outer)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries in floats; exact where they are below 2^53."""
    x, c = x.astype(float), book.astype(float)
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def full_search(x: np.ndarray, book: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds and exact squared distance of each row after a look at all entries."""
    n, k = len(x), len(book)
    far = squares(x, book)
    size = (x.astype(float) ** 2).sum(1) + (book.astype(float) ** 2).sum(1).max()
    slack = np.where(size < 2**51, 0.0, size * 2.0**-44)
    entry = far.argmin(1)
    least = far[np.arange(n), entry]
    unsure = np.flatnonzero((far <= (least + 2 * slack)[:, None]).sum(1) > 1)
    for i in unsure:  # in whole numbers; argmin takes the lower entry of a tie
        near = np.flatnonzero(far[i] <= least[i] + 2 * slack[i])
        entry[i] = near[((x[i] - book[near]) ** 2).sum(1).argmin()]
    exact = ((x - book[entry]) ** 2).sum(1)
    m = min(b + 1, k - 1)  # entries other than the row's own whose distance is kept
    far[np.arange(n), entry] = np.inf
    if m < 1:
        return Bounds(entry, _above(np.sqrt(exact)), np.zeros((n, 0), int), np.zeros((n, 0)), np.full(n, np.inf)).resized(b), exact
    order = np.argpartition(far, m - 1, axis=1)[:, :m]
    at = np.take_along_axis(far, order, 1)
    by = at.argsort(1, kind="stable")
    order, at = np.take_along_axis(order, by, 1), np.take_along_axis(at, by, 1)
    low = _below(np.sqrt(np.maximum(at - 2 * slack[:, None], 0)))
    outer = low[:, b] if m > b else np.full(n, np.inf)
    return Bounds(entry, _above(np.sqrt(exact)), order[:, :b], low[:, :b], outer).resized(b), exact


def bounded_search(x: np.ndarray, book: np.ndarray, moved: np.ndarray, old: Bounds, b: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """As ``full_search``, from the bounds of the round before; also how many listed entries each row needed a look at, ``b`` + 1
    where the outer bound failed. ``moved`` holds how far each entry has gone since."""
    n = len(x)
    step = np.append(moved, np.zeros(_NONE + 1 - len(moved)))
    upper = old.upper.astype(float)
    lower, listed = old.lower.astype(float) - step[old.listed], old.listed.astype(int)
    outer = old.outer.astype(float) - moved.max(initial=0)
    upper += moved[old.entry]
    lower = np.where(listed == _NONE, np.inf, lower)
    # in order from the outside in: a bound holds for all places from its own on
    chain = np.minimum.accumulate(np.hstack([lower, outer[:, None]])[:, ::-1], axis=1)[:, ::-1]
    entry = old.entry.astype(int)
    exact = ((x - book[entry]) ** 2).sum(1)
    tight = _above(np.sqrt(exact)).astype(float)
    upper = np.minimum(upper, tight)
    depth = (chain <= upper[:, None]).sum(1)
    real = (listed != _NONE).sum(1)
    fails = (depth > real) & (len(book) > 1) & (chain[:, -1] <= upper)
    depth = np.where(fails, b + 1, np.minimum(depth, real))
    out_lower, out_listed = lower.copy(), listed.copy()
    for d in np.unique(depth[(depth > 0) & (depth <= b)]):
        rows = np.flatnonzero(depth == d)
        seen = np.hstack([entry[rows, None], listed[rows, :d]])
        far = ((x[rows, None, :] - book[seen]) ** 2).sum(2)
        by = np.lexsort((seen, far), axis=1)  # nearest first, ties to the lower entry
        seen, far = np.take_along_axis(seen, by, 1), np.take_along_axis(far, by, 1)
        entry[rows], exact[rows] = seen[:, 0], far[:, 0]
        out_listed[rows, :d], out_lower[rows, :d] = seen[:, 1:], np.sqrt(far[:, 1:].astype(float)) * (1 - 1e-9)
    by = np.argsort(out_lower, axis=1, kind="stable")
    new = Bounds(entry, _above(np.sqrt(exact)), np.take_along_axis(out_listed, by, 1), _below(np.take_along_axis(out_lower, by, 1)), _below(outer)).resized(b)
    for lo in range(0, int(fails.sum()), _TASK_ROWS):
        rows = np.flatnonzero(fails)[lo : lo + _TASK_ROWS]
        again, exact[rows] = full_search(x[rows], book, b)
        new.entry[rows], new.upper[rows], new.listed[rows], new.lower[rows], new.outer[rows] = again.entry, again.upper, again.listed, again.lower, again.outer
    return new, exact, depth


def _assigner(d: int, books: np.ndarray, before: np.ndarray | None, old_b: list[int], new_b: list[int]):
    """Rows with their codes, squared distances and looks for one set of codebooks, and with their bounds for the next."""
    parts, entries, p = books.shape
    moved = None if before is None else np.sqrt(((books - before).astype(float) ** 2).sum(2)) * (1 + 1e-9)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TASK_ROWS):
                piece = batch.slice(at, _TASK_ROWS)
                n = piece.num_rows
                x = arrow_matrix(piece.column("x"), d).astype(np.int64).reshape(n, parts, p)
                state = None
                if moved is not None:
                    state = np.frombuffer(b"".join(piece.column("state").to_pylist()), np.uint8).reshape(n, -1)
                codes, looks, packed, error, place = [], [], [], np.zeros(n, np.int64), 0
                for k in range(parts):
                    if state is None:
                        bounds, exact = full_search(x[:, k], books[k], new_b[k])
                        depth = np.full(n, old_b[k] + 1)
                    else:
                        width = Bounds.width(old_b[k])
                        old = Bounds.unpack(state[:, place : place + width], old_b[k])
                        place += width
                        bounds, exact, depth = bounded_search(x[:, k], books[k], moved[k], old.resized(max(old_b[k], new_b[k])), max(old_b[k], new_b[k]))
                        depth = np.minimum(depth, new_b[k] + 1)
                        bounds = bounds.resized(new_b[k])
                    codes.append(bounds.entry)
                    looks.append(depth)
                    packed.append(bounds.pack())
                    error += exact
                rows = np.ascontiguousarray(np.concatenate(packed, axis=1))
                as_list = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(np.stack(v, 1).astype(np.int32).ravel()), parts).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("label"), piece.column("x"), as_list(codes), as_list(looks), pa.array(error), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["id", "label", "x", "code", "looks", "error", "state"],
                )

    return assign


def _entry_sums(rows: DataFrame, parts: int, p: int, read: Callable) -> None:
    """Reads count and componentwise sums of the parts of each entry, a stretch of ``WIDE`` components at a time."""
    stretches = [
        F.struct(F.lit(k).alias("part"), F.get("code", F.lit(k)).alias("entry"), F.lit(lo).alias("lo"),
                 *[(F.get("x", F.lit(k * p + lo + i)) if lo + i < p else F.lit(0).cast("long")).alias(f"x{i}") for i in range(WIDE)])
        for k in range(parts) for lo in range(0, p, WIDE)
    ]
    one = rows.select(F.explode(F.array(*stretches)).alias("s")).select("s.*")
    for r in one.groupBy("part", "entry", "lo").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(WIDE)]).collect():
        for i in range(min(WIDE, p - r["lo"])):
            read(r["part"], r["entry"], r["lo"] + i, r[f"x{i}"] // r["n"])


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, listed: tuple[int, int, int] = LISTED,
    looks: list | None = None,
) -> DataFrame:
    """One row for each usable row: ``id``, ``label``, ``code`` (array of entry numbers), ``error`` (long, the squared distances
    summed over parts) and ``codebooks_sha256``.

    Components become floor(scale * component). The codebooks begin with the parts of the ``entries`` smallest ids (ties by the
    vector, null ids last), fewer if there are fewer rows; an entry that no part is nearest to stays. Rows whose vector is null,
    empty, or holds null or non-finite components are left out, as are vectors of another length than most; a length that
    ``parts`` does not divide is filled up with zeros. Equal ids are rows of their own. Other columns are not used. ``looks``,
    where given, receives for each round and part the share of parts that had to be compared with all entries.
    """
    if not 0 < entries < _NONE:
        raise ValueError(f"between 1 and {_NONE - 1} entries, not {entries}")
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vec.alias("v")).where(whole_vector(F.col("v")))
    length, n = usual_length(rows, "v")
    if not n:
        return rows.select("id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    p = -(-length // parts)
    d = p * parts
    bound = min(LARGEST, isqrt((1 << 62) // p) // 2)
    whole = F.concat(floored(F.col("v"), scale, bound), F.array_repeat(F.lit(0).cast("long"), d - length))
    rows = cut(rows.where(F.size("v") == length).select("id", "label", whole.alias("x")))

    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(-1, parts, p).transpose(1, 0, 2).copy()
    least, now, most = listed
    top = len(first) - 1
    old_b = new_b = [min(now, top)] * parts
    before, current = None, rows
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    schema = f"id {id_type}, label {label_type}, x array<bigint>, code array<int>, looks array<int>, error long, state binary"
    for turn in range(rounds + 1):
        step = current.mapInArrow(_assigner(d, books, before, old_b, new_b), schema)
        if turn == rounds:
            current = step
            break
        seen = Observation()
        depth = [F.get("looks", F.lit(k)) for k in range(parts)]
        metrics = [F.avg((depth[k] > new_b[k]).cast("double")).alias(f"full{k}") for k in range(parts)]
        metrics += [F.percentile_approx(F.when(depth[k] <= new_b[k], depth[k]), 0.95).alias(f"deep{k}") for k in range(parts)]
        current = cut(step.observe(seen, *metrics))
        told = seen.get
        if looks is not None:
            looks.append([told[f"full{k}"] for k in range(parts)])
        old_b = new_b
        if turn:  # longer lists where many outer bounds fail, else as long as nearly all parts need
            new_b = [min(top, most, 2 * b if told[f"full{k}"] > 0.25 else max(least, (told[f"deep{k}"] or 0) + 1)) for k, b in enumerate(old_b)]
        before, books = books, books.copy()
        _entry_sums(current.select("x", "code"), parts, p, lambda k, e, i, mean: books.__setitem__((k, e, i), mean))
    mark = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return current.select("id", "label", "code", "error", F.lit(mark).alias("codebooks_sha256"))


def with_label_error(coded: DataFrame, broadcast_labels: int = BROADCAST_LABELS, salt: int = SALT) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels, nulls together. Up to ``broadcast_labels`` labels are
    broadcast; more are joined by shuffle, a label's rows in ``salt`` groups."""
    coded = cut(coded)
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"))
    if sums.limit(broadcast_labels + 1).count() <= broadcast_labels:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("same"))).drop("same")
    salted = sums.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    left = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(salt)).cast("int"))
    met = left.join(salted, F.col("label").eqNullSafe(F.col("same")) & (F.col("salt") == F.col("salt_of")))
    return met.drop("same", "salt", "salt_of")


def hex_code(code: Column) -> Column:
    """Two hexadecimal digits an entry number, in part order."""
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def oracle_sql() -> str:
    """The contract's query in DuckDB SQL: every round compares every part with every entry."""
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        "parts AS MATERIALIZED (SELECT r, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS v FROM kept, range(4) AS t(p))",
        "book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS c FROM parts WHERE r <= 256)",
    ]
    for k in range(ROUNDS + 1):
        far = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
        steps.append(f"near{k} AS MATERIALIZED (SELECT r, p, min({{'far': {far}, 'e': e}}) AS m FROM parts JOIN book{k} USING (p) GROUP BY r, p)")
        if k < ROUNDS:
            steps.append(f"""mean{k} AS MATERIALIZED (SELECT p, e, list(mean ORDER BY i) AS c FROM (
  SELECT p, m.e AS e, i, floor(sum(v[i]) / count(*)) AS mean FROM near{k} JOIN parts USING (r, p), range(1, 1000) AS t(i) WHERE i <= len(v) GROUP BY ALL) GROUP BY p, e)""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))")
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.far)::BIGINT AS error FROM near{ROUNDS} GROUP BY r)")
    steps.append(f"mark AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), mark"

"""A long-term store whose entries are rewritten: statements in order either open an entry or are merged into the entry that is
nearest at that moment, which then has a new text and a new vector that later statements meet.

The store is kept as versions with the span of positions in which they hold, so a statement's nearest entry is a join with the
versions that hold at its place, in blocks. Assignments start from a store that never changes; rounds rewrite the entries whose
members changed, match the statements behind the first change with the versions anew, and end when nothing changes. Up to the
first changed position everything is as in a pass one by one, and each round moves it on, so the end is that pass. A round asks
for texts only where the members of an entry differ from the round before; merges into one entry depend on each other and run in
order, entries run side by side.

Where the vectors of rewritten texts can be had inside a task (``encode``), no rounds are needed: stretches of a key's statements
pass one by one through one task, which carries the store, and the store goes on to the next stretch. A store that outgrows a
task is left to the rounds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql import types as T

from daytrace.functions import text as tx
from daytrace.functions.common import join_on
from daytrace.operators.infer import infer
from daytrace.operators.ordered import fold_sorted
from daytrace.operators.similarity import BLOCK_ROWS, block_pairs
from daytrace.session import cut, no_broadcasts

# Fixed values -----------------------------------------------------------------------------------------
MERGE_TYPES = ["generalize", "refine", "supersede", "contradict"]
TEXT_FIELD, TYPE_FIELD = "merged_proposition", "merge_type"
ALONE = "refine"  # the type of a statement that was merged with none
# ------------------------------------------------------------------------------------------------------
ASK = "Merge these statements into one:\n"
WRONG = "answer does not match the schema"
_END = 1 << 62
STRETCH, STORE_ROWS = 20_000, 5_000  # statements of a key that pass through one task at a time; entries it may hold

Client = Callable[[], Callable[[list[str]], list[str]]]
Encoder = Callable[[], Callable[[list[str]], Sequence]]


def merge_prompt(texts: list[str]) -> str:
    return ASK + json.dumps(texts, ensure_ascii=False, separators=(",", ":"))


def read_merge(answer: str) -> tuple[str, str]:
    """Text and type of an answer; anything else than an object of a text and a known type is an error."""
    try:
        found = json.loads(answer)
    except (TypeError, ValueError):
        raise ValueError(WRONG) from None
    if not isinstance(found, dict) or not isinstance(found.get(TEXT_FIELD), str) or found.get(TYPE_FIELD) not in MERGE_TYPES:
        raise ValueError(WRONG)
    return found[TEXT_FIELD], found[TYPE_FIELD]


def merge_writer(client: Client, calls: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A synthesizer for ``merge.synthesize_clusters``: the texts of each part become one text with a ``merge_type``."""

    def write(parts: DataFrame) -> DataFrame:
        told = infer(parts.withColumn("_prompt", F.concat(F.lit(ASK), F.to_json("texts"))), "_prompt", client, calls)
        body = tx.model_json("text")
        text, kind = F.get_json_object(body, f"$.{TEXT_FIELD}"), F.get_json_object(body, f"$.{TYPE_FIELD}")
        fits = F.coalesce(text.isNotNull() & kind.isin(MERGE_TYPES), F.lit(False))
        return told.withColumns({"text": text, "merge_type": kind, "error": F.coalesce("error", F.when(~fits, WRONG))}).drop("_prompt", "stats", "texts")

    return write


def _chains(members: DataFrame, keys: list[str], client: Client) -> DataFrame:
    """Versions of entries from their members in order (keys, entry, from, to, text, merge_type, error, prev): each holds behind ``from``
    up to ``to``; a failed step has none to hold. A step whose entry, members so far and predecessor were the same the round before
    keeps that round's answer."""
    held: dict = {}
    head = [members.schema[k] for k in keys]
    schema = T.StructType([*head, *T._parse_datatype_string("entry bigint, from bigint, to bigint, text string, merge_type string, error string, prev bigint").fields])

    def start(group: tuple) -> dict:
        return {"group": group, "text": None, "last": None, "same": True, "open": None}

    def step(state: dict, row: tuple):
        at, text, old_text, old_type, old_error, old_prev = (None if v != v else v for v in row)
        at, prev = int(at), state["last"]
        kind, error = ALONE, None
        if prev is not None:
            state["same"] = state["same"] and old_prev is not None and int(old_prev) == prev
            if state["same"]:
                text, kind, error = old_text, old_type, old_error
            else:
                try:
                    if "ask" not in held:
                        held["ask"] = client()
                    text, kind = read_merge(held["ask"]([merge_prompt([state["text"] or "", text or ""])])[0])
                except Exception as exc:  # noqa: BLE001 - a failing merge leaves the entry as it is
                    text, kind, error = state["text"], None, str(exc)
        state["text"], state["last"] = text, at
        if error is not None:
            return (*state["group"], at, None, text, kind, error, prev)
        before, state["open"] = state["open"], (at, text, kind, error, prev)
        return before and version(state["group"], before, at)

    def version(group: tuple, held_back: tuple, to: int) -> tuple:
        return (*group, held_back[0], to, *held_back[1:])

    fields = ["pos", "text", "_text", "_type", "_error", "_prev"]
    return fold_sorted(members, [*keys, "entry"], ["pos"], fields, start, step, lambda group, state: [version(group, state["open"], _END)], schema)


def _nearest(mains: DataFrame, versions: DataFrame, keys: list[str], theta: float, block_rows: int) -> DataFrame:
    """For each statement the nearest entry among the versions that hold at its place (the earliest on ties): keys, pos, into."""
    left = mains.select(*keys, F.col("pos").cast("bigint").alias("id"), "vec")
    right = versions.select(*keys, F.col("from").alias("id"), "entry", "to", "vec")
    lefts, rights = block_pairs(left, right, keys, "id", block_rows)
    rights = rights.select(*[F.col(c).alias(c) for c in rights.columns])
    head = [mains.schema[k] for k in keys]
    schema = T.StructType([*head, *T._parse_datatype_string("pos bigint, entry bigint, cos double").fields])
    matrix = lambda t: t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)

    def best(l: pa.Table, r: pa.Table) -> pa.Table:
        pos = entry = np.zeros(0, np.int64)
        cos = np.zeros(0)
        if l.num_rows and r.num_rows:
            r = r.sort_by("entry")
            at, since, until = l.column("id").to_numpy(), r.column("id").to_numpy(), r.column("to").to_numpy()
            sims = matrix(l) @ matrix(r).T
            holds = (since[None, :] < at[:, None]) & (at[:, None] <= until[None, :])
            sims = np.where(holds & (sims >= theta), sims, -np.inf)
            pick = sims.argmax(1)
            cos = sims[np.arange(len(at)), pick]
            some = np.flatnonzero(np.isfinite(cos))
            pos, entry, cos = at[some], r.column("entry").to_numpy()[pick[some]], cos[some]
        some = l if l.num_rows else r
        return pa.table({**{k: pa.repeat(some.column(k)[0], len(pos)) for k in keys}, "pos": pos, "entry": entry, "cos": cos})

    groups = [*keys, "_lb", "_rb"]
    found = lefts.groupBy(*groups).cogroup(rights.groupBy(*groups)).applyInArrow(best, schema)
    return found.groupBy(*keys, "pos").agg(F.max_by("entry", F.struct(F.col("cos"), -F.col("entry"))).alias("into"))


def _pass(keys: list[str], theta: float, client: Client, encode: Encoder, store_rows: int) -> Callable[[pa.Table], pa.Table]:
    """A stretch of a key's statements, one by one, after the entries (``held``) that the stretches before have left. A statement that
    the store has no room for, and those behind it, are not in the output."""
    ready: dict = {}

    def merged(texts: list[str]) -> tuple[str, str]:
        if "ask" not in ready:
            ready["ask"] = client()
        return read_merge(ready["ask"]([merge_prompt(texts)])[0])

    def vector(text: str) -> np.ndarray:
        if "encode" not in ready:
            ready["encode"] = encode()
        return np.asarray(ready["encode"]([text])[0], np.float64)

    def run(t: pa.Table) -> pa.Table:
        held = t.column("held").to_numpy()
        t = t.take(np.lexsort((t.column("pos").to_numpy(), ~held)))
        n, first = t.num_rows, int(held.sum())
        vec = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        pos, text = t.column("pos").to_pylist(), t.column("text").to_pylist()
        fields = ("pos", "text", "merge_type", "coded", "versions", "failures")
        store = t.slice(0, first).select(list(fields)).to_pylist()
        near = np.zeros((vec.shape[1], max(2, min(n, store_rows + 1, 2 * first + 64))))  # a column an entry
        near[:, :first] = vec[:first].T
        into: list = []
        for at in range(first, n):
            size = len(store)
            if size > store_rows:
                break
            best = None
            if size:
                # sums along the first axis run in order, so equal vectors have equal sums at every place
                sims = (near[:, : max(size, 2)] * vec[at][:, None]).sum(0)[:size]
                sims[~(sims >= theta)] = -np.inf
                best = int(sims.argmax())
            if best is None or not np.isfinite(sims[best]):
                if size == near.shape[1]:
                    near = np.concatenate([near, np.zeros_like(near)], axis=1)
                near[:, size] = vec[at]
                store.append({"pos": pos[at], "text": text[at], "merge_type": ALONE, "coded": False, "versions": 1, "failures": 0})
                into.append(None)
                continue
            entry = store[best]
            into.append(entry["pos"])
            try:
                new, kind = merged([entry["text"] or "", text[at] or ""])
            except Exception:  # noqa: BLE001 - a failing merge leaves the entry as it is
                entry["failures"] += 1
                continue
            if not entry["coded"] or new != entry["text"]:
                near[:, best] = vector(new)
            entry.update(text=new, merge_type=kind, coded=True, versions=entry["versions"] + 1)
        said, kept = len(into), len(store)
        rest = {c: pa.array([None] * said + [e[c] for e in store], t.schema.field(c).type) for c in fields[1:]}
        vecs = pa.array([None] * said + list(near[:, :kept].T), t.schema.field("vec").type)
        return pa.table({
            **{k: pa.repeat(t.column(k)[0], said + kept) for k in keys}, "held": pa.array([False] * said + [True] * kept),
            "pos": pa.array(pos[first : first + said] + [e["pos"] for e in store], pa.int64()), "into": pa.array(into + [None] * kept, pa.int64()), "vec": vecs, **rest})

    return run


def _settled(rows: DataFrame, keys: list[str], theta: float, client: Client, encode: Encoder, stretch: int, store_rows: int) -> tuple[DataFrame, DataFrame]:
    """Assignments (keys, pos, into) and entries (keys, pos, text, merge_type, versions, failures) of a pass one by one; a key that has
    more than ``store_rows`` entries is left off there."""
    blank = {"merge_type": "string", "coded": "boolean", "versions": "bigint", "failures": "bigint"}
    said = rows.select(
        *keys, F.lit(False).alias("held"), F.col("pos").cast("bigint").alias("pos"), F.lit(None).cast("bigint").alias("into"),
        F.col("vec").cast("array<double>").alias("vec"), "text", *[F.lit(None).cast(kind).alias(c) for c, kind in blank.items()])
    run = _pass(keys, theta, client, encode, store_rows)
    last = rows.agg(F.max("pos")).first()[0]
    found, store = said.where(F.lit(False)), said.where(F.lit(False))
    for at in range(0, -1 if last is None else last + 1, stretch):
        part = said.where(F.col("pos").between(at, at + stretch - 1))
        done = cut((part if at == 0 else part.unionByName(store)).groupBy(*keys).applyInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in said.schema])))
        found, store = found.unionByName(done.where(~F.col("held"))), done.where("held")
    return found.select(*keys, "pos", "into"), store.select(*keys, "pos", "text", "merge_type", "versions", "failures")


def _by_rounds(rows: DataFrame, first_guess: DataFrame, keys: list[str], theta: float, client: Client, embed: Callable[[Column], Column], block_rows: int, rounds: list | None) -> tuple[DataFrame, DataFrame]:
    """Assignments and entries as of ``_settled``, by rounds. There are many, each over tables of a row a statement: none is broadcast."""
    on = [*keys, "pos"]
    assigned = cut(first_guess.select(*on, F.col("into").cast("bigint").alias("into")))
    memo: DataFrame | None = None
    touched: DataFrame | None = None
    frontier: DataFrame | None = None
    while True:
        members = join_on(rows.select(*on, "text"), assigned, on).withColumn("entry", F.coalesce("into", "pos"))
        names = {"_text": "text", "_type": "merge_type", "_error": "error", "_prev": "prev"}
        if memo is None:
            due = members.withColumns({n: F.lit(None).cast("bigint" if n == "_prev" else "string") for n in names})
            written = _chains(due, keys, client)
        else:
            old = memo.select(*keys, "entry", F.col("from").alias("pos"), *[F.col(c).alias(n) for n, c in names.items()])
            due = join_on(join_on(members, touched, [*keys, "entry"], "left_semi"), old, [*keys, "entry", "pos"], "left")
            written = _chains(due, keys, client).unionByName(join_on(memo.drop("vec"), touched, [*keys, "entry"], "left_anti"))
        opened = rows.select(*keys, F.col("pos").alias("from"), F.col("vec").alias("_own"))
        vec = F.when(F.col("prev").isNull(), F.col("_own")).otherwise(embed(F.col("text")))
        memo = cut(join_on(written, opened, [*keys, "from"]).withColumn("vec", vec).drop("_own"))
        held = memo.where("error is null")
        behind = rows if frontier is None else join_on(rows, frontier, keys).where(F.col("pos") > F.col("_first"))
        near = _nearest(behind, held, keys, theta, block_rows)
        again = join_on(behind.select(*on), near, on, "left")
        # statements up to the frontier, and keys without any change, stay as they are
        both = join_on(assigned, again.withColumnRenamed("into", "_new").withColumn("_seen", F.lit(True)), on, "left")
        both = both.withColumn("_new", F.when(F.col("_seen"), F.col("_new")).otherwise(F.col("into"))).drop("_seen")
        differs = ~F.col("into").eqNullSafe(F.col("_new"))
        seen = Observation()
        both = cut(both.observe(seen, F.count_if(differs).alias("n")))
        n = seen.get["n"]
        if rounds is not None:
            rounds.append(n)
        if not n:
            break
        changed = both.where(differs)
        frontier = changed.groupBy(*keys).agg(F.min("pos").alias("_first"))
        ends = F.array(F.coalesce("into", "pos"), F.coalesce("_new", "pos"))
        touched = changed.select(*keys, F.explode(ends).alias("entry")).distinct()
        assigned = both.select(*on, F.col("_new").alias("into"))
    last = memo.groupBy(*keys, F.col("entry").alias("pos")).agg(
        F.max_by("text", F.col("from")).alias("text"), F.max_by("merge_type", F.when(F.col("error").isNull(), F.col("from"))).alias("merge_type"),
        F.count_if(F.col("error").isNull()).alias("versions"), F.count_if(F.col("error").isNotNull()).alias("failures"))
    return assigned, last


def roll_up(
    mains: DataFrame, first_guess: DataFrame, keys: Sequence[str], theta: float, client: Client, embed: Callable[[Column], Column],
    block_rows: int = BLOCK_ROWS, rounds: list | None = None, encode: Encoder | None = None, stretch: int = STRETCH, store_rows: int = STORE_ROWS,
) -> DataFrame:
    """Statements (keys, pos dense in order, text, unit vec and others) with ``kept`` (it opened an entry), ``into`` (the entry that
    took it in), and for kept ones the last ``text`` of the entry, its ``merge_type``, ``versions`` and ``failures``.

    ``first_guess`` holds keys, pos and an ``into`` to start from; it changes the number of rounds and not the result. ``embed``
    gives the unit vector of a rewritten text. A merge that fails leaves the entry as it is; the statement counts as taken in.
    ``rounds``, where given, receives the number of assignments that changed in each round. ``encode`` makes what gives the vectors of
    ``embed`` inside a task; with it, only keys with more than ``store_rows`` entries take rounds.
    """
    keys = list(keys)
    on = [*keys, "pos"]
    rows = cut(mains)
    with no_broadcasts(rows.sparkSession):
        if encode is None:
            assigned, last = _by_rounds(rows, first_guess, keys, theta, client, embed, block_rows, rounds)
        else:
            assigned, last = _settled(rows, keys, theta, client, encode, stretch, store_rows)
            wide = last.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > store_rows).drop("_n")
            if not wide.isEmpty():
                wide = cut(wide)
                left = join_on(rows, wide, keys, "left_semi")
                more, ends = _by_rounds(cut(left), join_on(left.select(*on), assigned, on, "left"), keys, theta, client, embed, block_rows, rounds)
                assigned = cut(join_on(assigned, wide, keys, "left_anti").unionByName(more))
                last = cut(join_on(last, wide, keys, "left_anti").unionByName(ends))
    out = join_on(rows.drop("vec"), assigned.hint("merge"), on).withColumn("kept", F.col("into").isNull())
    out = join_on(out, last.withColumnRenamed("text", "_last").hint("merge"), on, "left")
    return out.withColumn("text", F.coalesce("_last", "text")).drop("_last")

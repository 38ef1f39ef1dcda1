"""Typed text from key presses, as a chunked stack fold.

Spark turns every key press into one small edit (push an element, delete one, delete a word).  A chunk of
edits reduces to the deletions that reach below it and the elements it leaves; two such reductions compose
exactly, so a long session is folded chunk by chunk in parallel and only the reductions meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from daytrace.operators.cuts import CHUNK, Cuts, with_chunk
from daytrace.operators.ordered import fold_sorted, ordinal_chunk

# Fixed values -----------------------------------------------------------------------------------------
SHIFT_KEYS = "`1234567890-=[]\\;',./"
SHIFT_SYMBOLS = '~!@#$%^&*()_+{}|:"<>?'
DELETE_KEYS = ["backspace", "delete"]
IGNORED_KEYS = [
    "shift", "right_shift", "ctrl", "right_ctrl", "alt", "right_alt",
    "cmd", "right_cmd", "caps_lock", "fn", "menu", "meta", "none",
]
# ------------------------------------------------------------------------------------------------------

ONE, WORD, REST = "one", "word", "rest"


def edits(presses: DataFrame) -> DataFrame:
    """Adds ``op`` (push / one / word) and ``piece``; a key that types nothing pushes nothing.  (Filtering such
    rows here would copy the whole expression into a pushed-down predicate.)

    Input: event_type, action, key_char, modifiers MAP<STRING,BOOLEAN>.
    """
    def held(*names: str) -> Column:
        return F.coalesce(F.greatest(*[F.coalesce(F.col("modifiers")[n], F.lit(False)) for n in names]), F.lit(False))

    # named columns first, so that each is computed once and not at every use below
    rows = presses.where((F.col("event_type") == "key_press") & (F.col("action") == "down")).select(
        "*", F.regexp_replace(F.coalesce(F.col("key_char"), F.lit("None")), r"^\s+|\s+$", "").alias("_key"),
        held("cmd", "right_cmd", "meta").alias("_cmd"), held("ctrl", "right_ctrl").alias("_ctrl"),
        held("alt", "right_alt").alias("_alt"), held("shift", "right_shift").alias("_shift"),
        F.coalesce(F.col("modifiers")["caps_lock"], F.lit(False)).alias("_caps"),
    )
    key, cmd, ctrl, alt, shift, caps = (F.col(c) for c in ("_key", "_cmd", "_ctrl", "_alt", "_shift", "_caps"))
    shortcut = F.concat(
        F.lit("<"),
        F.concat_ws("+", F.when(cmd, "cmd"), F.when(ctrl, "ctrl"), F.when(alt, "alt"), F.when(shift, "shift"), key),
        F.lit(">"),
    )
    letter = (F.length(key) == 1) & key.rlike(r"^\p{L}$")
    piece = (
        F.when(key.isin(IGNORED_KEYS), F.lit(None))
        .when(cmd | ctrl | alt, F.when(key != "space", shortcut))
        .when(key == "space", " ")
        .when(key.isin("enter", "return"), "\n")
        .when(key == "tab", "\t")
        .when(F.length(key) > 1, F.concat(F.lit("<"), key, F.lit(">")))
        .when(letter, F.when(shift != caps, F.upper(key)).otherwise(F.lower(key)))
        .when(shift, F.translate(key, SHIFT_KEYS, SHIFT_SYMBOLS))
        .otherwise(key)
    )
    op = F.when(key.isin(DELETE_KEYS), F.when(ctrl, WORD).otherwise(ONE)).otherwise("push")
    return (
        rows.withColumn("op", op).withColumn("piece", F.when(op == "push", piece))
        .drop("_key", "_cmd", "_ctrl", "_alt", "_shift", "_caps")
    )


def _delete(stack: list, op: str):
    """Apply one deletion; returns the deletion still owed below the stack, or None."""
    if op == ONE:
        if not stack:
            return ONE
        stack.pop()
        return None
    if op == WORD:
        while stack and stack[-1].isspace():
            stack.pop()
        if not stack:
            return WORD
    while stack and not stack[-1].isspace():
        stack.pop()
    return None if stack else REST


def typed_text(
    presses: DataFrame, keys: Sequence[str], order: str = "ord", chunk_size: int | Cuts | None = 65_536
) -> DataFrame:
    """One row per key with the reconstructed ``text``.  Keys without any edit give an empty text.
    ``chunk_size=None`` folds each key at once, for keys known to be small."""
    keys = list(keys)
    heads = [presses.schema[k] for k in keys]
    strings = T.ArrayType(T.StringType())
    reduced_type = T.StructType([*heads, T.StructField(CHUNK, T.LongType()), T.StructField("owed", strings), T.StructField("stack", strings)])

    def empty(group: tuple) -> dict:
        return {"owed": [], "stack": []}

    def edit(state: dict, row: tuple) -> None:
        op, piece = row
        if op == "push":
            if piece:
                state["stack"].append(piece)
        elif left := _delete(state["stack"], op):
            state["owed"].append(left)

    def join(state: dict, row: tuple) -> None:
        for op in row[0]:
            _delete(state["stack"], op)
        state["stack"].extend(row[1])

    text_type = T.StructType([*heads, T.StructField("text", T.StringType())])

    def text(group: tuple, state: dict) -> list:
        return [(*group, "".join(state["stack"]))]

    rows = edits(presses)
    if chunk_size is None:
        texts = fold_sorted(rows, keys, [order], ["op", "piece"], empty, edit, text, text_type)
    else:
        rows = with_chunk(rows, ordinal_chunk(order, chunk_size))
        reduced = fold_sorted(
            rows, [*keys, CHUNK], [order], ["op", "piece"], empty, edit,
            lambda group, state: [(*group, state["owed"], state["stack"])], reduced_type)
        texts = fold_sorted(reduced, keys, [CHUNK], ["owed", "stack"], empty, join, text, text_type)
    return presses.select(*keys).distinct().join(texts, keys, "left").na.fill("", ["text"])

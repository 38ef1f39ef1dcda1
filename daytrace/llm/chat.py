"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events is folded into final messages: ``message`` begins one, ``delta`` appends to it, ``edit`` and ``regenerate``
replace what it held (a regenerated answer is empty until its deltas arrive). The messages of a conversation are then rendered in order with
marked turns. Texts cannot forge a mark: every ``#``, ``<`` and backslash inside them is written as a two-character code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
# Fixed codes; the backslash is coded first and decoded last.
CODES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]
LOSS_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in CODES if role else CODES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", message: str = "message", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages: conv, seq (of the event that began the message), role, text.

    Events are taken in the order of ``seq`` (null first), then role and text; later events of a message go to the last
    ``message`` event of the same message id before them, and those that have none begin one themselves. Equal ``message``
    events are separate messages. A null kind counts as ``message``, null text as empty, null role as the empty role; a role
    given later by a ``delta`` or ``edit`` does not change the message's.
    """
    rows = events.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{message}`").alias("message"),
        F.col(f"`{seq}`").alias("seq"),
        F.coalesce(F.col(f"`{kind}`"), F.lit("message")).alias("kind"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    order = ["seq", "role", "text"]
    by_message = Window.partitionBy("conv", "message").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    started = rows.withColumn("start", F.sum((F.col("kind") == "message").cast("long")).over(by_message))
    one = Window.partitionBy("conv", "message", "start").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = started.withColumn("version", F.sum(F.col("kind").isin("edit", "regenerate").cast("long")).over(one))
    piece = F.struct("version", "seq", "role", "text")
    folded = counted.groupBy("conv", "message", "start").agg(
        F.min(F.struct("seq", "role")).alias("first"),
        F.max("version").alias("last"),
        F.sort_array(F.collect_list(piece)).alias("pieces"),
    )
    kept = F.filter("pieces", lambda p: p["version"] == F.col("last"))
    return folded.select(
        "conv", F.col("first.seq").alias("seq"), F.col("first.role").alias("role"), F.concat_ws("", F.transform(kept, lambda p: p["text"])).alias("text")
    )


def render(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row for each conversation of ``fold``'s messages: conv, formatted, and ``turns``, an array with a turn's start, the start
    of its text, the length of its text as written, and whether it is under the loss mask (offsets in code points, from 0).
    Messages of one ``seq`` are put in the order of role and text. Null conversation ids make one conversation."""
    piece = F.concat(F.lit(HEAD), escape(F.col("role"), True), F.lit(MIDDLE), escape(F.col("text")), F.lit(TAIL))
    head = F.length(F.concat(F.lit(HEAD), escape(F.col("role"), True), F.lit(MIDDLE)))
    rows = messages.select("conv", "seq", "role", "text", piece.alias("piece"), head.alias("head"))
    order = Window.partitionBy("conv").orderBy("seq", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "conv",
        "piece",
        F.row_number().over(order).alias("at"),
        F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("start"),
        "head",
        (F.col("role") == loss_role).alias("loss"),
    )
    turn = F.struct("at", "piece", "start", (F.col("start") + F.col("head")).alias("text_start"), (F.length("piece") - F.col("head") - len(TAIL)).alias("text_length"), "loss")
    whole = placed.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    return whole.select(
        "conv",
        F.concat_ws("", "all.piece").alias("formatted"),
        F.transform("all", lambda t: F.struct(t["start"].alias("start"), t["text_start"].alias("text_start"), t["text_length"].alias("text_length"), t["loss"].alias("loss"))).alias("turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of ``render``'s output again, from the string and the mask alone: conv, formatted, and arrays ``roles``,
    ``texts`` and ``loss_texts`` (the text under the mask, turn by turn; empty outside it)."""
    pieces = formatted.select("conv", "formatted", F.arrays_zip(F.slice(F.split("formatted", TAIL), 1, F.size("turns")).alias("piece"), F.col("turns").alias("turn")).alias("both"))
    under = lambda b: F.substr(b["piece"], (b["turn"]["text_start"] - b["turn"]["start"] + 1).cast("int"), b["turn"]["text_length"].cast("int"))
    return pieces.select(
        "conv",
        "formatted",
        F.transform("both", lambda b: unescape(F.substring_index(F.substr(b["piece"], F.lit(len(HEAD) + 1)), MIDDLE, 1))).alias("roles"),
        F.transform("both", lambda b: unescape(F.regexp_replace(b["piece"], f"(?s)^{HEAD}[^:]*{MIDDLE}", ""))).alias("texts"),
        F.transform("both", lambda b: F.when(b["turn"]["loss"], unescape(under(b))).otherwise(F.lit(""))).alias("loss_texts"),
    )

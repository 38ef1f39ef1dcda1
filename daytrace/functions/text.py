"""Scalar text, time and formatting expressions; all are plain Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from daytrace.functions.common import let

# Fixed values -----------------------------------------------------------------------------------------
CODE_WORDS = ["true", "false", "none", "null", "undefined", "div", "span", "body", "view"]
SINGLE_CHARS_KEPT = ["+", "-", "=", "%", "$"]
SCORE_LABELS = [
    (0.8, "Very High Similarity"),
    (0.6, "High Similarity"),
    (0.4, "Moderate Similarity"),
    (0.2, "Low Similarity"),
]
LOWEST_LABEL = "Very Low Similarity"
FRAME_NAME = r"(?i)^frame_(\d+)_idx_(\d+)\.jpg$"
NOISE_TOKEN = r"^(?:[0-9]+|0x[0-9a-f]+|[0-9a-f]{8,}|true|false|null|undefined)$"
NOISE_TOKEN_STRICT = (
    r"^(?:[0-9]+|true|false|null|undefined|[a-z0-9]{1,3}|[a-z0-9]{12,}|0x[0-9a-f]+)$"
)
# US letter keys and, position by position, what the Ukrainian layout types on them.
LAYOUT_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,./`"
LAYOUT_CHARS = "йцукенгшщзхїфівапролджєячсмитьбю.₴"
# ------------------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Strip every kind of white space at both ends (``trim`` alone strips only blanks)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def strip_think(c: Column | str) -> Column:
    """Drop ``<think>…</think>`` blocks, across lines, and surrounding white space."""
    return trim_ws(F.regexp_replace(_col(c), r"(?s)<think>.*?</think>", ""))


def strip_fence(c: Column | str) -> Column:
    """Drop a surrounding code fence and its ``json`` tag."""
    t = _col(c)
    inner = trim_ws(F.regexp_replace(t, r"^`+|`+$", ""))
    return F.when(t.startswith("```"), trim_ws(F.regexp_replace(inner, r"(?i)^json\b", ""))).otherwise(t)


def outer_braces(c: Column | str) -> Column:
    """Substring between the first ``{`` and the last ``}``; null when there is none."""
    return F.nullif(F.regexp_extract(_col(c), r"(?s)(\{.*\})", 1), F.lit(""))


def is_json(c: Column | str) -> Column:
    return F.try_parse_json(_col(c)).isNotNull()


def model_json(c: Column | str) -> Column:
    """JSON text inside a model answer, or null when nothing parses (callers keep the raw text)."""
    def pick(clean: Column) -> Column:
        inner = outer_braces(clean)
        return F.when(is_json(clean), clean).otherwise(let(inner, lambda i: F.when(is_json(i), i)))

    return let(strip_think(c), lambda t: let(strip_fence(t), pick))


def repair_json(c: Column | str) -> Column:
    """Flatten line breaks and drop trailing commas before ``}`` and ``]``."""
    t = F.replace(trim_ws(c), F.lit("\n"), F.lit(" "))
    return F.replace(F.replace(t, F.lit(",}"), F.lit("}")), F.lit(",]"), F.lit("]"))


def first_json(c: Column | str) -> Column:
    """Widest ``{…}`` or ``[…]`` span, line breaks removed; null when absent."""
    span = F.regexp_extract(_col(c), r"(?s)(\{.*\}|\[.*\])", 1)
    return F.nullif(trim_ws(F.replace(span, F.lit("\n"), F.lit(""))), F.lit(""))


def letters_only(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"[^A-Za-z]+", " "))


def drop_repeated_ending(c: Column | str) -> Column:
    """Collapse a repeated last word to one occurrence; words are joined by one blank."""
    words = F.filter(F.split(_col(c), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"))

    def cut(ws: Column) -> Column:
        ending = F.aggregate(
            ws, start, lambda s, w: F.struct(w.alias("word"), F.when(w == s["word"], s["run"] + 1).otherwise(1).alias("run"))
        )
        return F.array_join(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - ending["run"] + 1, F.lit(0))), " ")

    return let(words, cut)


def is_garbage(c: Column | str) -> Column:
    """Interface noise: one odd character, a code word, or a short ``#…`` token."""
    t = _col(c)
    short = ~t.rlike(r"^\d$") & ~t.isin(SINGLE_CHARS_KEPT)
    return F.when(F.length(t) < 2, short).otherwise(
        F.lower(t).isin(CODE_WORDS) | (t.startswith("#") & (F.length(t) < 8))
    )


def token_count(c: Column | str) -> Column:
    """Pieces of a split on single blanks; empty pieces count."""
    return F.size(F.split(_col(c), " ", -1))


def tokenize(c: Column | str, strict: bool = False) -> Column:
    """Distinct lower-case alphanumeric tokens, first-seen order."""
    parts = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^a-z0-9]+")
    if strict:
        return F.array_distinct(F.filter(parts, lambda w: (w != "") & ~w.rlike(NOISE_TOKEN_STRICT)))
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) > 1))


def meaningful(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.rlike(NOISE_TOKEN))


def decode_layout(c: Column | str) -> Column:
    """Re-type text written on the wrong keyboard layout; ``<…>`` tokens stay as they are."""
    upper = [(k.upper(), v.upper()) for k, v in zip(LAYOUT_KEYS, LAYOUT_CHARS) if k.upper() != k]
    keys = LAYOUT_KEYS + "".join(k for k, _ in upper)
    chars = LAYOUT_CHARS + "".join(v for _, v in upper)
    pieces = F.regexp_extract_all(_col(c), F.lit(r"(?s)(<[^>]+>|[^<]+|<)"), F.lit(1))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike(r"(?s)^<[^>]+>$"), p).otherwise(F.translate(p, keys, chars)),
        ),
        "",
    )


def choose_text(original: Column, decoded: Column, original_english: Column, decoded_english: Column) -> Column:
    return F.when(original_english & ~decoded_english, original).otherwise(decoded)


def format_seconds(c: Column | str) -> Column:
    return F.format_string("%.2fs", _col(c).cast("double"))


def iso_epoch(c: Column | str) -> Column:
    """Epoch seconds of an ISO string (no zone = session zone, pinned to UTC); 0.0 when unreadable."""
    ts = F.try_to_timestamp(_col(c))
    return F.coalesce(F.unix_micros(ts) / F.lit(1e6), F.lit(0.0))


def frame_parts(c: Column | str) -> Column:
    """``frame_<id>_idx_<n>.jpg`` → struct(frame_id, global_idx); null for other names."""
    name = _col(c)
    return F.when(
        name.rlike(FRAME_NAME),
        F.struct(
            F.regexp_extract(name, FRAME_NAME, 1).cast("int").alias("frame_id"),
            F.regexp_extract(name, FRAME_NAME, 2).cast("bigint").alias("global_idx"),
        ),
    )


def frame_time(start: Column, fps: Column, start_idx: Column, idx: Column) -> Column:
    """Wall-clock time of a frame: segment start plus its offset."""
    offset = (idx - start_idx) / fps
    return F.timestamp_micros((F.unix_micros(start.cast("timestamp")) + F.round(offset * 1e6)).cast("bigint"))


def run_name(c: Column | str) -> Column:
    """``method__mods`` file stem, parted at the first ``__`` → struct(method, modalities), without a leading ``merged+``; a stem
    that has no ``__`` is all method."""
    stem = F.regexp_replace(F.element_at(F.split(_col(c), "/"), -1), r"\.[^.]*$", "")
    return F.struct(
        F.split_part(stem, F.lit("__"), F.lit(1)).alias("method"),
        F.regexp_replace(F.regexp_replace(stem, r"^(?:(?!__).)*(?:__)?", ""), r"^merged\+", "").alias("modalities"),
    )


def video_name(c: Column | str) -> Column:
    return F.replace(F.element_at(F.split(_col(c), r"[/\\]"), -1), F.lit(".avi"), F.lit(".mp4"))


def model_slug(c: Column | str) -> Column:
    return F.lower(F.replace(F.element_at(F.split(_col(c), "/"), -1), F.lit("-"), F.lit("_")))


def modality_label(prefix: Column, has_ocr: Column) -> Column:
    return (
        F.when(prefix.isin("ax", "metadata"), prefix)
        .when(has_ocr, F.lit("screen_ocr"))
        .otherwise(F.lit("screen_pure"))
    )


def score_label(c: Column | str) -> Column:
    s = _col(c)
    out = F.when(s >= SCORE_LABELS[0][0], SCORE_LABELS[0][1])
    for bound, label in SCORE_LABELS[1:]:
        out = out.when(s >= bound, label)
    return out.otherwise(LOWEST_LABEL)


def merge_text(summary: Column, transcription: Column, merge_on: str) -> Column:
    s = trim_ws(F.coalesce(summary, F.lit("")))
    t = trim_ws(F.coalesce(transcription, F.lit("")))
    if merge_on in ("summary-only", "summary"):
        return s
    if merge_on == "transcription":
        return t
    if merge_on == "both":
        return F.concat_ws("\n\n", F.nullif(s, F.lit("")), F.nullif(t, F.lit("")))
    raise ValueError(f"unknown merge mode: {merge_on}")


def window_info(data: Column) -> Column:
    """Window titles, else current windows with changes, else a fixed note.  Lists are shown as JSON."""
    def shown(field: str) -> Column:
        return F.coalesce(F.to_json(data[field]), F.lit("null"))

    titles, current = data["window_titles"], data["current_windows"]
    return (
        F.when(F.coalesce(F.size(titles), F.lit(0)) > 0, F.concat(F.lit("Window Titles: "), F.to_json(titles)))
        .when(
            F.coalesce(F.size(current), F.lit(0)) > 0,
            F.concat(
                F.lit("Current Windows: "), F.to_json(current),
                F.lit(", Added: "), shown("added_windows"),
                F.lit(", Removed: "), shown("removed_windows"),
            ),
        )
        .otherwise(F.lit("No window info"))
    )


def numbered_prompt(base: Column, items: Column, kind: str) -> Column:
    """Prompt text with its records in order: ``ocr`` blocks, ``ax`` or ``metadata`` records."""
    if kind == "ocr":
        blocks = F.transform(
            items, lambda t, i: F.concat(F.lit("[SCREENSHOT "), i + 1, F.lit("]\n" + "-" * 20 + "\n"), t)
        )
        return F.concat(base, F.lit("\n\n### Input (OCR Text)\n"), F.array_join(blocks, "\n\n"))
    label = {"ax": "Accessibility record", "metadata": "Metadata record"}[kind]
    blocks = F.transform(items, lambda t, i: F.concat(F.lit(f"\n\n{label} "), i, F.lit(": "), t))
    return F.concat(base, F.array_join(blocks, ""))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out

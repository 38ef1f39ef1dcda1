"""User profiles from statements of any number, by a reduce tree of bounded prompts.

Statements become lines, lines are cut into parts under a token budget, and each part is answered by a partial profile. Partial
profiles that lie side by side are merged under the same budget, level by level, until one is left. Every level is one grouped
pass over all users, so no prompt, group or task grows with a user.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from daytrace.functions import text as tx
from daytrace.functions.common import join_on
from daytrace.operators.infer import infer
from daytrace.operators.ordered import Ordered, ordinal_chunk
from daytrace.session import cut, cut_counted

# Sections of a profile; a field holds a list of texts unless it is named in SINGLE --------
PROFILE_FIELDS = {
    "static_profile": {
        "demographics": ["name_or_alias", "country_or_region", "native_language", "other_languages", "age_range", "education_level", "other_demographic_notes"],
        "background_knowledge_skills": ["background", "knowledge_domains", "skills"],
        "goals_and_needs": ["long_term_goals", "short_term_goals", "needs"],
        "personality_traits": ["cognitive_working_style", "collaboration_communication_style", "other_traits"],
    },
    "dynamic_profile": {
        "behaviors": ["recent_tasks", "workflows_patterns", "time_use_characterization"],
        "preferences_interests": ["short_term_interests", "long_term_interests", "tool_preferences", "interaction_preferences"],
    },
}
SINGLE = {"name_or_alias", "country_or_region", "native_language", "age_range", "education_level"}
# ------------------------------------------------------------------------------------------------------
TOKENS = 6_000


def profile_type() -> str:
    """The profile as a type."""
    kind = lambda f: f"{f}: " + ("string" if f in SINGLE else "array<string>")
    section = lambda name, fields: f"{name}: struct<{', '.join(kind(f) for f in fields)}>"
    return "struct<" + ", ".join(f"{part}: struct<{', '.join(section(n, f) for n, f in sections.items())}>" for part, sections in PROFILE_FIELDS.items()) + ">"


def _words(text: Column) -> Column:
    return F.size(F.split(text, " "))


def statement_lines(rows: DataFrame, keys: Sequence[str], order: str, most: int) -> DataFrame:
    """Statements (``text``, confidence, decay) as numbered lines in order: keys, i, piece, line, tokens. One of more than ``most``
    tokens goes on over several pieces under the same number, so that no line is longer."""
    placed = Ordered(rows, list(keys), [order], ordinal_chunk(order)).ordinal("i").done()
    words = F.split(F.coalesce("text", F.lit("")), " ")
    last = F.greatest(F.ceil(F.size(words) / most), F.lit(1)).cast("int") - 1
    cutting = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(words, k * most + 1, most), " "))
    line = F.concat(
        F.lit("- id: "), F.col("i").cast("string"), F.lit('\n  proposition: "'), F.col("_text"), F.lit('"\n  confidence: '),
        F.coalesce(F.col("confidence").cast("string"), F.lit("null")), F.lit("\n  decay: "), F.coalesce(F.col("decay").cast("string"), F.lit("null")), F.lit("\n"))
    return placed.select(*keys, "i", "confidence", "decay", F.posexplode(cutting).alias("piece", "_text")).select(
        *keys, "i", "piece", line.alias("line"), _words(F.col("_text")).cast("bigint").alias("tokens"))


def _parts(rows: DataFrame, keys: list[str], by: list[str], text: str, part: Column) -> DataFrame:
    """Neighbours in the order ``by`` that have one value of ``part``, which may use the place ``_n`` and the running tokens ``_c``:
    keys, part, texts."""
    placed = Ordered(rows, keys, by, ordinal_chunk(by[0])).ordinal("_n").running_sum("_c", F.col("tokens")).done()
    return placed.groupBy(*keys, part.cast("bigint").alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", text))), lambda e: e[text]).alias("texts"))


def generate_profiles(
    statements: DataFrame, keys: Sequence[str], order: str, client: Callable[[], Callable[[list[str]], list[str]]],
    first_prompt: Callable[[Column], Column], merge_prompt: Callable[[Column], Column], tokens: int = TOKENS, calls: int = 1,
) -> DataFrame:
    """One row a user: ``profile`` (struct of ``profile_type``), ``json`` (the last answer), ``parts`` and ``levels`` (how many partial
    profiles there were, and how often they were merged) and ``error``.

    ``statements`` hold keys, ``order``, text, confidence and decay. ``first_prompt`` makes a prompt of a part's lines as one text,
    ``merge_prompt`` one of an array of partial profiles. A part holds lines of fewer than ``tokens`` tokens and the one that
    reaches them, so less than twice ``tokens``; a merge takes at least two profiles. A part that fails, or whose answer is no JSON
    object, fails its user, with the first error; the others go on. Users without statements have no row.
    """
    keys = list(keys)

    def answered(asked: DataFrame) -> DataFrame:
        told = infer(asked.select(*keys, "part", "prompt"), "prompt", client, calls)
        answer = tx.model_json("text")
        is_object = F.coalesce(F.startswith(F.ltrim(answer), F.lit("{")), F.lit(False))
        return told.select(*keys, "part", answer.alias("text"), F.coalesce("error", F.when(~is_object, "answer is no JSON object")).alias("error"))

    lines = statement_lines(statements, keys, order, tokens)
    # a part ends with the line that reaches the budget
    parts = _parts(lines, keys, ["i", "piece"], "line", F.expr(f"(_c - tokens) div {tokens}"))
    told = cut(answered(parts.withColumn("prompt", first_prompt(F.array_join("texts", "")))))
    counts = told.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"))
    done: list[DataFrame] = []
    level = 0
    while True:
        bad = told.where("error is not null").groupBy(*keys).agg(F.min_by("error", "part").alias("error"))
        good = join_on(told.drop("error"), bad.select(*keys), keys, "left_anti")
        sized = join_on(good, good.groupBy(*keys).agg(F.count(F.lit(1)).alias("_left")), keys)
        done.append(bad.select(*keys, F.lit(None).cast("string").alias("json"), F.lit(level).alias("levels"), "error"))
        done.append(sized.where("_left = 1").select(*keys, F.col("text").alias("json"), F.lit(level).alias("levels"), F.lit(None).cast("string").alias("error")))
        rest, left = cut_counted(sized.where("_left > 1").select(*keys, "part", "text", _words(F.col("text")).cast("bigint").alias("tokens")))
        if not left:
            break
        level += 1
        # as many neighbours as fit the budget and two more at most; never more groups than half of the profiles, so levels end
        groups = cut(_parts(rest, keys, ["part"], "text", F.least(F.expr("_n div 2"), F.expr(f"_c div {tokens}"))))
        alone = groups.where(F.size("texts") == 1).select(*keys, "part", F.col("texts")[0].alias("text"), F.lit(None).cast("string").alias("error"))
        merged = answered(groups.where(F.size("texts") > 1).withColumn("prompt", merge_prompt(F.col("texts"))))
        told = cut(merged.unionByName(alone))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = join_on(out, counts, keys)
    return out.select(*keys, F.from_json("json", profile_type()).alias("profile"), "json", "parts", "levels", "error")


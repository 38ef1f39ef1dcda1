"""Benchmark decontamination by template windows, in DataFrame functions only.

Numbers, names and units become typed slots, so a question whose figures or people were changed keeps its template. Windows of
``WINDOW`` template tokens are hashed and joined with those of the benchmark items; windows that lie on one diagonal (the
same distance between text and item) are taken together, and in each run of them the slots must agree: one value of the item has
to stand for one value of the text. Windows that are equal throughout count by themselves: enough of them are a verbatim leak,
with those that are only consistent it is a re-parameterised one. Every capitalised word is a slot; items also go in with their
first word the other way, and without names, as a text may quote them inside a sentence or in small letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from daytrace.session import cut

WINDOW = 8
SHARE = 0.5  # of an item's windows
RUN = 13  # or so many tokens in one stretch
BROADCAST_WINDOWS = 1_000_000  # benchmark windows that may be broadcast; beyond it the join shuffles
NUMBER, NAME, UNIT, FIRST = "\u0001", "\u0002", "\u0003", "\u0004"
LITERALS = 4  # in a window of fewer literal tokens every slot stands for itself: it takes words to know a question again
# Fixed list of unit words; they count as units after a number only.
UNITS = "kg g mg lb lbs oz km m cm mm mi ft inch inches mile miles meter meters metre metres l ml liter liters litre litres hour hours hr hrs minute minutes min second seconds sec day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees mph kmh kg/h".split()
KEY = ["text_hash", "text_hash2", "text_length"]


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; a null text has the key of the empty one."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias(KEY[0]), F.hash(text).alias(KEY[1]), F.length(text).alias(KEY[2])]


def _has(text: Column, *marks: str) -> Column:
    found = text.contains(marks[0])
    for mark in marks[1:]:
        found = found | text.contains(mark)
    return found


def _step(text: Column, needs: tuple[str, ...], pattern: str, to: str) -> Column:
    """A replacement that texts without any of the characters it is about pass by."""
    return _once(text, lambda t: F.when(_has(t, *needs), F.regexp_replace(t, pattern, to)).otherwise(t))


def slotted(text: Column, first: bool = False, names: bool = True) -> Column:
    """Lower-case tokens in one string; a slot is its mark followed by its value. A name is a capitalised word, wherever it
    stands; with ``first`` the value of one that may only begin a sentence (that does not follow a small letter, a digit or a
    comma and a blank) has the mark ``FIRST`` before it."""
    t = _step(F.coalesce(text, F.lit("")), (NUMBER, NAME, UNIT, FIRST), r"[\x01-\x04]", " ")
    if first and names:
        t = F.regexp_replace(t, r"\p{Lu}(?<=[\p{Ll}\p{N},;] .)\p{Ll}+", f"{NAME}$0")
        t = F.regexp_replace(t, r"(?<![\p{L}\p{N}\x02])\p{Lu}\p{Ll}+", f"{NAME}{FIRST}$0")
    elif names:
        t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+", f"{NAME}$0")
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\x01-\x04.,$€£%]+|[.,](?!\d)|[.,](?<!\d.)", " ")
    t = _step(t, ("$", "€", "£", "%"), r"[$€£%]", f" {UNIT}$0 ")
    t = F.regexp_replace(t, r"\d+(?:[.,]\d+)*", f" {NUMBER}$0 ")
    t = _step(t, ("  ",), " +", " ")
    t = _step(t, (NUMBER,), rf"(\x01\S+ )({'|'.join(UNITS)})(?= |$)", f"$1{UNIT}$2")
    return F.btrim(t)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda's argument: a slice of it is taken for every window."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _item_forms(text: Column) -> Column:
    """The forms of an item: all capitalised words slots, the same with its first word the other way, and no names."""
    other = lambda s: F.when(s.startswith(NAME), F.regexp_replace(s, r"^\x02\x04?", "")).when(s.rlike(r"^\p{L}"), F.concat(F.lit(NAME + FIRST), s)).otherwise(s)
    return _once(slotted(text, first=True), lambda s: F.array_distinct(F.array(s, other(s), slotted(text, names=False))))


def _windows_of(tokens: Column, n: int) -> Column:
    hashes, values, slot = tokens["hashes"], tokens["values"], tokens["slot"]
    starts = F.when(F.size(hashes) >= n, F.sequence(F.lit(1), F.size(hashes) - n + 1)).otherwise(F.array().cast("array<int>"))
    is_slot = lambda v: F.substring(v, 1, 1).isin(NUMBER, NAME, UNIT)
    slots = lambda i: F.when(F.array_contains(F.slice(slot, i, n), True), F.filter(F.slice(values, i, n), is_slot))
    window = lambda i, found: F.struct(i.alias("pos"), F.lit(n).alias("length"), F.xxhash64(F.slice(hashes, i, n)).alias("hash"), found.alias("slots"))
    plain = F.transform(starts, lambda i: window(i, F.lit(None).cast("array<string>")))
    return F.when(F.size(slot) > 0, F.transform(starts, lambda i: window(i, slots(i)))).otherwise(plain)


def windows(full: Column, lengths: list[int]) -> Column:
    """Array of windows of a slotted text: pos, length, hash of the template's token hashes, values of the slots (null where
    there are none)."""

    def tokens(full: Column) -> Column:
        values = F.when(_has(full, NUMBER, NAME, UNIT), F.split(full, " ")).otherwise(F.array().cast("array<string>"))
        return F.struct(_template_hashes(full).alias("hashes"), values.alias("values"), F.transform(values, lambda v: F.substring(v, 1, 1).isin(NUMBER, NAME, UNIT)).alias("slot"))

    return _once(full, lambda full: _once(tokens(full), lambda t: F.concat(*[_windows_of(t, n) for n in lengths])))


def _template_hashes(full: Column) -> Column:
    template = F.when(_has(full, NUMBER, NAME, UNIT), F.regexp_replace(full, r"([\x01-\x03])\S+", "$1")).otherwise(full)
    return F.transform(F.split(template, " "), lambda w: F.xxhash64(w))


def window_hashes(full: Column, lengths: list[int]) -> Column:
    """Only the hashes of ``windows``: the hash of an array is that of its elements one after the other, so no array is cut out."""
    at = lambda h, i, n: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
    none = F.array().cast("array<bigint>")
    of = lambda h, n: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: at(h, i, n))).otherwise(none)
    return _once(full, lambda full: _once(_template_hashes(full), lambda h: F.concat(*[of(h, n) for n in lengths])))


def _met_texts(docs: DataFrame, text_col: str, items: DataFrame, lengths: list[int], broadcast_windows: int, small: bool) -> DataFrame:
    """The rows of ``docs`` that have a window of some item by hash. Nothing but a text's key and hashes is made before that join, so
    the values of slots are taken for these texts alone."""
    wanted = items.select("hash").distinct()
    row = lambda k, h: F.struct(*[k[name].alias(name) for name in KEY], h.alias("hash"))
    # key and hash in one struct: a column beside the exploded one would have the windows made a second time
    rows = lambda t: _once(F.struct(*text_key(t)), lambda k: F.transform(window_hashes(slotted(t), lengths), lambda h: row(k, h)))
    found = docs.select(F.explode(_once(F.col(f"`{text_col}`"), rows)).alias("w")).select("w.*")
    met = found.join(F.broadcast(wanted) if small else wanted, "hash", "left_semi")
    hits = cut(met.select(*[F.col(k).alias(f"met_{k}") for k in KEY]).distinct())
    few = hits.limit(broadcast_windows + 1).count() <= broadcast_windows
    same = [k == F.col(f"met_{name}") for k, name in zip(text_key(F.col(f"`{text_col}`")), KEY)]
    return docs.join(F.broadcast(hits) if few else hits, same, "left_semi")


def leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: float = SHARE, run: int = RUN, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row for each distinct text and item that it leaks: the text's key (``text_key``), item, n_windows, share, kind
    (``verbatim`` or ``reparameterised``); of several diagonals the one with most windows, the verbatim one first.

    A leak needs ``share`` of the item's windows on one diagonal, or as many as ``run`` tokens give, and slots that agree.
    A window with fewer than ``LITERALS`` literal tokens counts only where its slots' values are those of the item.
    Items of fewer than ``window`` tokens are one window of their own length; those without tokens, and null texts, match nothing.
    """
    raw = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("t")).where(F.col("item").isNotNull()).distinct()
    sized = raw.withColumn("tokens", F.size(F.filter(F.split(slotted(F.col("t")), " "), lambda w: w != "")))
    short = [r["tokens"] for r in sized.where(F.col("tokens").between(1, window - 1)).select("tokens").distinct().collect()]
    lengths = sorted({window, *short})
    w = F.explode(F.array_distinct(F.flatten(F.transform(_item_forms(F.col("t")), lambda s: windows(s, lengths))))).alias("w")
    items = sized.where("tokens > 0").select("item", "tokens", w).where(F.col("w.length") == F.least(F.lit(window), F.col("tokens")))
    total = F.col("tokens") - F.col("w.length") + 1
    items = cut(items.select("item", total.alias("total"), F.col("w.pos").alias("item_pos"), F.col("w.length").alias("length"), F.col("w.hash").alias("hash"), F.col("w.slots").alias("item_slots")))
    small = items.limit(broadcast_windows + 1).count() <= broadcast_windows
    side = F.broadcast(items) if small else items
    docs = _met_texts(docs, text_col, items, lengths, broadcast_windows, small)

    # exploded as one array of structs made in place: from a column of its own, the optimizer would infer a filter on the windows
    # and push it below the semi-join, so that the windows of all texts would be made
    row = lambda k, w: F.struct(*[k[name].alias(name) for name in KEY], *[w[name].alias(name) for name in ("pos", "length", "hash", "slots")])
    rows = lambda t: _once(F.struct(*text_key(t)), lambda k: F.transform(windows(slotted(t), lengths), lambda w: row(k, w)))
    found = docs.select(F.explode(_once(F.col(f"`{text_col}`"), rows)).alias("w")).select("w.*")
    met = found.join(side, ["hash", "length"])
    few = F.col("length") - F.size("slots") < LITERALS
    pair = lambda i, v: F.struct(F.replace(i, F.lit(FIRST), F.lit("")).alias("item_value"), v.alias("value"), few.alias("fixed"))
    pairs = F.when(F.col("slots").isNotNull(), F.zip_with("item_slots", "slots", pair)).otherwise(F.array().cast("array<struct<item_value:string,value:string,fixed:boolean>>"))
    equal = lambda p: p["item_value"] == p["value"]
    met = met.withColumn("pairs", pairs).where(F.forall("pairs", lambda p: ~p["fixed"] | equal(p)))
    one = F.struct("item_pos", F.transform("pairs", lambda p: F.struct(p["item_value"].alias("item_value"), p["value"].alias("value"))).alias("pairs"))
    diagonal = met.withColumn("shift", F.col("pos") - F.col("item_pos")).groupBy(*KEY, "item", "shift").agg(
        F.array_sort(F.collect_set(one)).alias("met"), F.first("total").alias("total"), F.first("length").alias("length")
    )
    # runs: windows at consecutive places; where the slots of one disagree, only its windows that are equal count
    at = F.transform("met", lambda m: m["item_pos"])
    starts, ends = F.filter(at, lambda p: ~F.array_contains(at, p - 1)), F.filter(at, lambda p: ~F.array_contains(at, p + 1))
    inside = lambda lo, hi: F.filter("met", lambda m: m["item_pos"].between(lo, hi))
    same = lambda run: F.size(F.filter(run, lambda m: F.forall(m["pairs"], equal)))

    def counted(run: Column) -> Column:
        pairs = F.array_distinct(F.flatten(F.transform(run, lambda m: m["pairs"])))
        agrees = F.size(F.array_distinct(F.transform(pairs, lambda p: p["item_value"]))) == F.size(pairs)
        return F.when(agrees, F.size(run)).otherwise(same(run))

    runs = F.zip_with(starts, ends, lambda lo, hi: counted(inside(lo, hi)))
    diagonal = diagonal.select(*KEY, "item", "total", "length", same(F.col("met")).alias("equal"), F.aggregate(runs, F.lit(0), lambda a, n: a + n).alias("n_windows"))
    enough = lambda n: (n >= share * F.col("total")) | ((F.col("length") == window) & (n >= run - window + 1))
    kept = diagonal.where(enough(F.col("n_windows"))).select(*KEY, "item", F.struct(enough(F.col("equal")).cast("int").alias("same"), "n_windows", (F.col("n_windows") / F.col("total")).alias("share")).alias("d"))
    best = kept.groupBy(*KEY, "item").agg(F.max(F.struct("d.n_windows", "d.same", "d.share")).alias("d"))
    return best.select(*KEY, "item", "d.n_windows", "d.share", F.when(F.col("d.same") == 1, "verbatim").otherwise("reparameterised").alias("kind"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, with their own columns."""
    found = leaks(docs, benchmark, text_col, **options).select(*[F.col(k).alias(f"leak_{k}") for k in KEY]).distinct()
    keyed = docs.select(F.struct("*").alias("row"), *text_key(F.col(f"`{text_col}`")))
    same = [F.col(k) == F.col(f"leak_{k}") for k in KEY]
    return keyed.join(found, same, "left_anti").select("row.*")

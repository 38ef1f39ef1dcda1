"""Sessions, metrics, pairs, batches, frames: framed on ``events`` (app boundary = view) and
``conversations`` (pairs of turns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daytrace.functions import text as tx
from daytrace.operators import frames as fr
from daytrace.operators import keystrokes, pairs, sessions
from daytrace.operators.cuts import Cuts, fit
from daytrace.operators.ordered import Ordered, fitting_size, ordinal_chunk, time_chunk
from daytrace.plans.registry import query, r6, table, us

TYPES = ["click", "error", "purchase", "signup"]

EV = """ev AS (SELECT user_id AS u, event_id AS ord, ts, epoch_us(ts) AS us, event_type AS et, value AS x,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y FROM events)"""
SES = """app AS (SELECT u, us AS s, lead(us) OVER w AS e, row_number() OVER w - 1 AS sid
  FROM ev WHERE et = 'view' WINDOW w AS (PARTITION BY u ORDER BY us, ord)),
ses AS (SELECT * FROM app WHERE e IS NOT NULL)"""
ASG = """asg AS (SELECT ev.*, ses.sid FROM ev JOIN ses ON ev.u = ses.u AND ev.us >= ses.s AND ev.us < ses.e
  WHERE ev.et <> 'view')"""


def activity(spark, sf) -> DataFrame:
    """events as an activity log: x = value, y = props.k."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("user"), F.col("event_id").alias("ord"), "ts", "event_type",
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"),
    )


def session_tables(spark, sf) -> tuple[DataFrame, DataFrame, Cuts | None]:
    rows = activity(spark, sf)
    width = fit(rows, ["user"], ["ts"])
    ses = sessions.build_sessions(rows.where("event_type = 'view'").select("user", "ts", "ord"), ["user"], width)
    return ses, sessions.assign_events(ses, rows.where("event_type <> 'view'"), ["user"], width), width


@query("w1_session_bounds", f"""WITH {EV}, {SES} SELECT u AS "user", sid AS session_id, s AS start_us, e AS end_us,
  round((e - s) / 1e6, 6) AS duration FROM ses""")
def session_bounds(spark, sf):
    ses, _, _ = session_tables(spark, sf)
    return ses.select("user", "session_id", us("start").alias("start_us"), us("end").alias("end_us"), r6("duration", "duration"))


@query("j1_assign_events", f"""WITH {EV}, {SES}, {ASG} SELECT u AS "user", sid AS session_id, ord AS event_id FROM asg""")
def assign(spark, sf):
    _, asg, _ = session_tables(spark, sf)
    return asg.select("user", "session_id", F.col("ord").alias("event_id"))


@query("j1_session_activity", f"""WITH {EV}, {SES}, {ASG}, c AS (SELECT u, sid, count(*) AS n,
  count(*) FILTER (et = 'click') AS c1, count(*) FILTER (et = 'error') AS c2,
  count(*) FILTER (et = 'purchase') AS c3, count(*) FILTER (et = 'signup') AS c4 FROM asg GROUP BY u, sid)
SELECT ses.u AS "user", ses.sid AS session_id, round((e - s) / 1e6, 6) AS duration, coalesce(n, 0) AS n_events,
  coalesce(c1, 0) AS n_click, coalesce(c2, 0) AS n_error, coalesce(c3, 0) AS n_purchase, coalesce(c4, 0) AS n_signup
FROM ses LEFT JOIN c ON ses.u = c.u AND ses.sid = c.sid""")
def session_activity(spark, sf):
    ses, asg, _ = session_tables(spark, sf)
    out = sessions.activity_counts(ses, asg, ["user"], TYPES)
    return out.select("user", "session_id", r6("duration", "duration"), "n_events", *[f"n_{t}" for t in TYPES])


@query("p1_event_range", """SELECT event_id, user_id AS "user", event_type FROM events
WHERE event_type IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""")
def event_range(spark, sf):
    rows = table(spark, sf, "events")
    kind = rows.schema["ts"].dataType
    out = sessions.filter_range(
        rows, F.lit("2024-01-05").cast(kind), F.lit("2024-01-20").cast(kind), ["click", "purchase"])
    return out.select("event_id", F.col("user_id").alias("user"), "event_type")


@query("w2_islands", f"""WITH {EV}, f AS (SELECT *, CASE WHEN et = lag(et) OVER w THEN 0 ELSE 1 END AS nw FROM ev
  WINDOW w AS (PARTITION BY u ORDER BY ord)), g AS (SELECT *, sum(nw) OVER (PARTITION BY u ORDER BY ord) AS isl FROM f)
SELECT u AS "user", CAST(isl - 1 AS BIGINT) AS id, min(ord) AS first_event, any_value(et) AS event_type,
  round(sum(x), 4) AS duration FROM g GROUP BY u, isl""")
def islands(spark, sf):
    rows = activity(spark, sf).select("user", "ord", "event_type", F.col("x").alias("duration"))
    out = sessions.merge_repeats(rows, ["user"], ["event_type"], ["ord"], fit(rows, ["user"], ["ord"]))
    return out.select("user", "id", F.col("ord").alias("first_event"), "event_type", r6("duration", "duration", 4))


@query("w3_pointer_steps", f"""WITH {EV}, {SES}, {ASG}, m AS (SELECT u, sid, ord, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py
  FROM asg WHERE et = 'click' WINDOW w AS (PARTITION BY u, sid ORDER BY us, ord))
SELECT u AS "user", sid AS session_id, ord AS event_id, round(coalesce(sqrt((x-px)*(x-px) + (y-py)*(y-py)), 0), 4) AS step FROM m""")
def pointer_steps(spark, sf):
    _, asg, width = session_tables(spark, sf)
    keys = ["user", "session_id"]
    rows = (
        Ordered(asg.where("event_type = 'click'"), keys, ["ts", "ord"], time_chunk("ts", width))
        .lag("px", F.col("x")).lag("py", F.col("y")).done()
    )
    step = F.coalesce(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0))
    return rows.select(*keys, F.col("ord").alias("event_id"), r6(step, "step", 4))


@query("a1_pointer_metrics", f"""WITH {EV}, {SES}, {ASG}, m AS (SELECT u, sid, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w) + (y-lag(y) OVER w)*(y-lag(y) OVER w)) AS d
  FROM asg WHERE et = 'click' WINDOW w AS (PARTITION BY u, sid ORDER BY us, ord)),
p AS (SELECT u, sid, sum(d) FILTER (d < 300) AS path FROM m GROUP BY u, sid),
b AS (SELECT u, sid, count(*) AS n, (max(us) - min(us)) / 1e6 AS dur, count(*) FILTER (et = 'purchase') AS clicks,
  (max(x) - min(x)) * (max(y) - min(y)) AS area FROM asg GROUP BY u, sid HAVING count(*) >= 2)
SELECT b.u AS "user", b.sid AS session_id, round(coalesce(path, 0), 6) AS total_distance_px,
  round(CASE WHEN dur > 0 THEN coalesce(path, 0) / dur ELSE 0 END, 6) AS avg_speed_px_s, clicks AS click_count,
  round(area, 6) AS screen_area_used FROM b LEFT JOIN p ON b.u = p.u AND b.sid = p.sid""")
def pointer_metrics(spark, sf):
    _, asg, width = session_tables(spark, sf)
    out = sessions.mouse_metrics(
        asg, ["user", "session_id"], move_type="click", click=F.col("event_type") == "purchase", jump=300.0, digits=6, chunk_seconds=width)
    return out.select(
        "user", "session_id", r6("total_distance_px", "total_distance_px"), r6("avg_speed_px_s", "avg_speed_px_s"),
        "click_count", r6("screen_area_used", "screen_area_used"))


@query("w4_flight_times", f"""WITH {EV}, f AS (SELECT u, ord, (lead(us) OVER (PARTITION BY u ORDER BY ord) - us) / 1e6 AS fl FROM ev WHERE et <> 'view')
SELECT u AS "user", ord AS event_id, round(fl, 6) AS flight FROM f WHERE fl < 20000""")
def flight_times(spark, sf):
    rows = activity(spark, sf).where("event_type <> 'view'").withColumn("t", us("ts") / F.lit(1e6))
    out = Ordered(rows, ["user"], ["ord"], fit(rows, ["user"], ["ord"])).lead("nt", F.col("t")).done()
    flight = F.round(F.col("nt") - F.col("t"), 6)
    return out.where(flight < 20000).select("user", F.col("ord").alias("event_id"), r6(flight, "flight"))


@query("a2_typing_metrics", f"""WITH {EV}, {SES}, {ASG}, f AS (SELECT u, sid, (lead(us) OVER (PARTITION BY u, sid ORDER BY ord) - us) / 1e6 AS fl FROM asg),
g AS (SELECT u, sid, count(*) AS presses, count(fl) FILTER (fl < 20000) AS n, coalesce(sum(fl) FILTER (fl < 20000), 0) AS tot,
  avg(fl) FILTER (fl < 20000) AS av, stddev_samp(fl) FILTER (fl < 20000) AS sd FROM f GROUP BY u, sid)
SELECT u AS "user", sid AS session_id, CASE WHEN presses < 2 THEN 1 ELSE 0 END AS short,
  coalesce(CASE WHEN presses >= 2 THEN n END, 0) AS sample_size,
  round(CASE WHEN presses >= 2 AND tot > 0 THEN (n + 1) / tot ELSE 0 END, 2) AS kps,
  round(CASE WHEN presses >= 2 AND tot > 0 THEN (n + 1) / 5.0 / (tot / 60) ELSE 0 END, 2) AS wpm,
  round(CASE WHEN presses >= 2 AND n > 0 THEN av ELSE 0 END, 1) AS avg_flight_time,
  round(CASE WHEN presses >= 2 AND n > 0 THEN coalesce(sd, 0) ELSE 0 END, 1) AS flight_time_sd FROM g""")
def typing(spark, sf):
    _, asg, width = session_tables(spark, sf)
    rows = asg.withColumn("timestamp_precise", us("ts") / F.lit(1e6))
    size = fit(activity(spark, sf), ["user"], ["ord"])
    out = sessions.typing_metrics(rows, ["user", "session_id"], pause=20000.0, time_digits=1, chunk_size=size)
    return out.select(
        "user", "session_id", F.col("note").isNotNull().cast("int").alias("short"),
        F.coalesce("sample_size", F.lit(0)).alias("sample_size"), r6("kps", "kps", 2), r6("wpm", "wpm", 2),
        r6("avg_flight_time", "avg_flight_time", 1), r6("flight_time_sd", "flight_time_sd", 1))


@query("f1_typed_text", f"""WITH {EV}, {SES}, {ASG}, k AS (SELECT u, sid, ord, CASE et WHEN 'click' THEN chr(97 + CAST(y AS INT) % 26)
  WHEN 'purchase' THEN chr(65 + CAST(y AS INT) % 26) WHEN 'signup' THEN ' ' WHEN 'error' THEN '<' ELSE '>' END AS c FROM asg),
l AS (SELECT u, sid, list(c ORDER BY ord) AS cs FROM k GROUP BY u, sid)
SELECT u AS "user", sid AS session_id, list_reduce(list_prepend('', cs), lambda acc, c: CASE WHEN c = '<' THEN left(acc, length(acc) - 1)
  WHEN c = '>' THEN regexp_replace(acc, '[^ ]* *$', '') ELSE acc || c END) AS text FROM l""")
def typed(spark, sf):
    _, rows, _ = session_tables(spark, sf)
    letter = F.char(F.lit(97) + F.pmod(F.col("y").cast("int"), F.lit(26)))
    key = (
        F.when(F.col("event_type").isin("click", "purchase"), letter)
        .when(F.col("event_type") == "signup", "space").otherwise("backspace")
    )
    held = F.create_map(
        F.lit("shift"), F.col("event_type") == "purchase", F.lit("ctrl"), F.col("event_type") == "view")
    presses = rows.select(
        "user", "session_id", "ord", F.lit("key_press").alias("event_type"), F.lit("down").alias("action"),
        key.alias("key_char"), held.alias("modifiers"))
    return keystrokes.typed_text(presses, ["user", "session_id"], chunk_size=fit(presses, ["user", "session_id"], ["ord"]))


@query("w5_w6_pairs_history", """WITH t AS (SELECT conv_id, turn, role || ':' || length(text) AS tag FROM conversations),
p AS (SELECT a.conv_id, a.turn // 2 AS pair_idx, a.tag AS first_tag, b.tag AS second_tag, a.turn FROM t a
  JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0)
SELECT p.conv_id, pair_idx, first_tag, second_tag,
  coalesce((SELECT string_agg(h.tag, ',' ORDER BY h.turn) FROM t h WHERE h.conv_id = p.conv_id AND h.turn < p.turn AND h.turn >= p.turn - 3), '') AS history FROM p""")
def pairs_history(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("tag"))
    out = pairs.pair_records(rows, ["conv_id"], "turn", ["tag"], history=3)
    return out.select(
        "conv_id", "pair_idx", F.col("first.tag").alias("first_tag"), F.col("second.tag").alias("second_tag"),
        F.array_join(F.transform("history", lambda h: h["tag"]), ",").alias("history"))


W7_BUDGET = 1200


@query("w7_pairs_within_budget", f"""WITH RECURSIVE d AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
  length(text) - length(replace(text, ' ', '')) + 1 AS tok FROM documents),
p AS (SELECT a.lang, a.i // 2 AS p, a.i AS a, b.i AS b, a.tok AS ta, b.tok AS tb FROM d a JOIN d b ON a.lang = b.lang AND b.i = a.i + 1 WHERE a.i % 2 = 0),
r AS (SELECT lang, CAST(-1 AS BIGINT) AS p, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS ha, CAST(0 AS BIGINT) AS hb, FALSE AS kept, '' AS hist, '' AS ids
    FROM (SELECT DISTINCT lang FROM d)
  UNION ALL SELECT p.lang, p.p, p.a, p.b,
    CASE WHEN p.ta + p.tb + r.ha + r.hb <= {W7_BUDGET} THEN p.ta ELSE r.ha END, CASE WHEN p.ta + p.tb + r.ha + r.hb <= {W7_BUDGET} THEN p.tb ELSE r.hb END,
    p.ta + p.tb + r.ha + r.hb <= {W7_BUDGET}, r.ids,
    CASE WHEN p.ta + p.tb + r.ha + r.hb <= {W7_BUDGET} THEN p.a || ',' || p.b ELSE r.ids END
  FROM r JOIN p ON p.lang = r.lang AND p.p = r.p + 1)
SELECT lang, p AS pair_idx, a AS first_id, b AS second_id, hist AS history FROM r WHERE kept""")
def budget_pairs(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "doc_id", tx.token_count("text").alias("tokens"))
    placed = Ordered(docs, ["lang"], ["doc_id"], fit(docs, ["lang"], ["doc_id"])).ordinal("idx").done()
    size = fitting_size(placed, ["lang"], "idx")
    out = pairs.pairs_within_budget(placed, ["lang"], "idx", "tokens", history=2, budget=W7_BUDGET, chunk_pairs=size)
    return out.select("lang", "pair_idx", "first_id", "second_id", F.array_join(F.col("history_ids").cast("array<string>"), ",").alias("history"))


LAYERS = """s AS (SELECT conv_id, turn // 2 AS pair_idx, turn, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn // 2 AS pair_idx, turn, text FROM conversations WHERE role = 'assistant')"""


def layers(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("pair_idx", F.expr("turn div 2"))
    s = rows.where("role = 'user'").select("conv_id", "pair_idx", F.col("text").alias("summary"), F.col("turn").alias("start"))
    t = rows.where("role = 'assistant'").select("conv_id", "pair_idx", F.col("text").alias("transcription"), F.col("turn").alias("end"))
    return s, t


@query("j2_common_pairs", f"""WITH {LAYERS} SELECT s.conv_id, s.pair_idx, md5(s.text) AS summary, md5(a.text) AS transcription
FROM s JOIN a ON s.conv_id = a.conv_id AND s.pair_idx = a.pair_idx""")
def common_pairs(spark, sf):
    s, t = layers(spark, sf)
    out = pairs.join_layers(s, t, ["conv_id", "pair_idx"])
    return out.select("conv_id", "pair_idx", F.md5("summary").alias("summary"), F.md5("transcription").alias("transcription"))


@query("j3_all_summaries", f"""WITH {LAYERS} SELECT s.conv_id, s.pair_idx, md5(s.text) AS summary, length(coalesce(a.text, '')) AS transcription_chars
FROM s LEFT JOIN a ON s.conv_id = a.conv_id AND s.pair_idx = a.pair_idx""")
def all_summaries(spark, sf):
    s, t = layers(spark, sf)
    out = pairs.join_layers(s, t, ["conv_id", "pair_idx"], keep_all=True)
    return out.select("conv_id", "pair_idx", F.md5("summary").alias("summary"), F.length("transcription").alias("transcription_chars"))


@query("a3_a4_observation_batches", f"""WITH {LAYERS}, j AS (SELECT s.conv_id, s.pair_idx, s.turn AS st, a.turn AS en,
    '--- Pair ' || s.pair_idx || E' ---\\n\\n' || CASE WHEN s.text <> '' THEN E'## Summary\\n' || s.text || E'\\n\\n' ELSE '' END
    || CASE WHEN a.text <> '' THEN E'## Transcription\\n' || a.text || E'\\n\\n' ELSE '' END AS body
  FROM s JOIN a ON s.conv_id = a.conv_id AND s.pair_idx = a.pair_idx),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY pair_idx) - 1) // 2 AS batch_id FROM j)
SELECT conv_id, batch_id, string_agg(CAST(pair_idx AS VARCHAR), ',' ORDER BY pair_idx) AS pair_indices,
  md5(string_agg(body, E'\\n' ORDER BY pair_idx)) AS content, min(st) AS start_turn, max(en) AS end_turn, CAST(0 AS BIGINT) AS missing_ranges
FROM n GROUP BY conv_id, batch_id""")
def batches(spark, sf):
    s, t = layers(spark, sf)
    both = pairs.join_layers(s, t, ["conv_id", "pair_idx"])
    out = pairs.batch_observations(both, ["conv_id"], k=2, chunk_size=fit(s, ["conv_id"], ["pair_idx"]))
    return out.select(
        "conv_id", "batch_id", F.array_join(F.col("pair_indices").cast("array<string>"), ",").alias("pair_indices"),
        F.md5("content").alias("content"), F.col("start").alias("start_turn"), F.col("end").alias("end_turn"), "missing_ranges")


def dense_events(spark, sf) -> DataFrame:
    rows = activity(spark, sf)
    return Ordered(rows, ["user"], ["ts", "ord"], fit(rows, ["user"], ["ts", "ord"])).ordinal("pos").done()


def dense_size(spark, sf) -> int | None:
    """Chunk size for dense per-user positions; None when no user is large."""
    return None if fitting_size(activity(spark, sf), ["user"], "ord") is None else 250_000


DENSE = f"""WITH {EV}, d AS (SELECT u, us, ord, y, row_number() OVER (PARTITION BY u ORDER BY us, ord) - 1 AS pos,
  count(*) OVER (PARTITION BY u) AS n FROM ev)"""


@query("j5_metadata_ranges", f"""{DENSE}, p AS (SELECT u, pos // 2 AS pair_idx, pos AS a, pos + 1 AS b, n FROM d WHERE pos % 2 = 0 AND pos + 1 < n)
SELECT p.u AS "user", pair_idx, s.us AS start_us, e.us AS end_us FROM p JOIN d s ON s.u = p.u AND s.pos = a
  JOIN d e ON e.u = p.u AND e.pos = least(b + 1, p.n - 1)""")
def metadata_ranges(spark, sf):
    return _pair_ranges(spark, sf, "metadata")


@query("j5_ax_ranges", f"""{DENSE}, p AS (SELECT u, pos // 2 AS pair_idx, pos AS a, pos + 1 AS b, n FROM d WHERE pos % 2 = 0 AND pos + 1 < n)
SELECT p.u AS "user", pair_idx, s.us AS start_us, e.us AS end_us FROM p JOIN d s ON s.u = p.u AND s.pos = least(a + 1, p.n - 1)
  JOIN d e ON e.u = p.u AND e.pos = least(b + 2, p.n - 1)""")
def ax_ranges(spark, sf):
    return _pair_ranges(spark, sf, "ax")


def _pair_ranges(spark, sf, modality):
    rows = dense_events(spark, sf)
    app = rows.select("user", F.col("pos").alias("ord"), us("ts").alias("ts"))
    found = pairs.pair_records(rows, ["user"], "pos", ["pos"], history=2)
    ids = found.select("user", "pair_idx", F.col("first.pos").alias("a"), F.col("second.pos").alias("b"))
    out = pairs.pair_ranges(ids, app, ["user"], modality)
    return out.select("user", "pair_idx", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query("j6_frame_pair_ranges", f"""{DENSE} SELECT p.u AS "user", p.pos, coalesce(CASE WHEN q.us IS NOT NULL THEN least(p.us, q.us) END, -1) AS start_us,
  coalesce(CASE WHEN q.us IS NOT NULL THEN greatest(p.us, q.us) END, -1) AS end_us FROM d p LEFT JOIN d q ON q.u = p.u AND q.pos = p.pos + 3""")
def frame_ranges(spark, sf):
    rows = dense_events(spark, sf)
    name = lambda c: F.concat(F.lit("frame_"), c.cast("string"))
    frames = rows.select("user", name(F.col("pos")).alias("filename"), us("ts").alias("ts"))
    asked = rows.select("user", "pos", name(F.col("pos")).alias("frame1"), name(F.col("pos") + 3).alias("frame2"))
    out = pairs.frame_pair_ranges(asked, frames, ["user"])
    return out.select("user", "pos", F.coalesce("start", F.lit(-1)).alias("start_us"), F.coalesce("end", F.lit(-1)).alias("end_us"))


SEG = f"""{DENSE}, g AS (SELECT u, pos, CAST(sum(y) OVER w - y + 1 AS BIGINT) AS start_idx, CAST(sum(y) OVER w AS BIGINT) AS end_idx, y / 30.0 AS fps, y
  FROM d WINDOW w AS (PARTITION BY u ORDER BY pos))"""


def segments(spark, sf):
    rows = dense_events(spark, sf).withColumn("frames", F.col("y").cast("bigint")).withColumn("seconds", F.lit(30.0))
    return fr.segment_bounds(rows, ["user"], "pos", "frames", "seconds", dense_size(spark, sf))


@query("w8_segment_bounds", f"""{SEG} SELECT u AS "user", pos, start_idx, end_idx, round(fps, 6) AS fps FROM g""")
def segment_bounds(spark, sf):
    return segments(spark, sf).select("user", "pos", "start_idx", "end_idx", r6("fps", "fps"))


@query("j4_locate_frames", f"""{SEG}, f AS (SELECT u, ord, 1 + (ord * 37) % 6000 AS idx FROM d)
SELECT f.u AS "user", f.ord AS event_id, f.idx AS global_idx, coalesce(g.pos, -1) AS segment,
  round(coalesce((f.idx - g.start_idx) / g.fps, -1), 6) AS video_offset_sec
FROM f LEFT JOIN g ON g.u = f.u AND f.idx BETWEEN g.start_idx AND g.end_idx""")
def locate(spark, sf):
    frames = activity(spark, sf).select("user", F.col("ord").alias("event_id"), (1 + (F.col("ord") * 37) % 6000).alias("global_idx"))
    size = fit(frames, ["user"], ["global_idx"])
    out = fr.locate_frames(frames, segments(spark, sf), ["user"], ["pos"], size)
    return out.select(
        "user", "event_id", "global_idx", F.coalesce("pos", F.lit(-1)).alias("segment"),
        r6(F.coalesce("video_offset_sec", F.lit(-1.0)), "video_offset_sec"))


@query("t3_stable_frames", f"""{DENSE.replace('WITH', 'WITH RECURSIVE', 1)}, f AS (SELECT u, pos + 1 AS seq, CAST(y AS INT) // 40 AS sig FROM d),
r AS (SELECT u, CAST(0 AS BIGINT) AS seq, -1 AS saved, -1 AS cand, CAST(0 AS BIGINT) AS at, 0 AS calm, 0 AS n, CAST(-1 AS BIGINT) AS hit FROM (SELECT DISTINCT u FROM f)
 UNION ALL SELECT f.u, f.seq,
  CASE WHEN f.sig <> r.saved AND f.sig = r.cand AND r.calm + 1 >= 2 THEN r.cand ELSE r.saved END,
  CASE WHEN f.sig = r.saved THEN -1 WHEN f.sig <> r.cand THEN f.sig WHEN r.calm + 1 >= 2 THEN -1 ELSE r.cand END,
  CASE WHEN f.sig <> r.saved AND f.sig <> r.cand THEN f.seq ELSE r.at END,
  CASE WHEN f.sig = r.saved OR f.sig <> r.cand OR r.calm + 1 >= 2 THEN 0 ELSE r.calm + 1 END,
  CASE WHEN f.sig <> r.saved AND f.sig = r.cand AND r.calm + 1 >= 2 THEN r.n + 1 ELSE r.n END,
  CASE WHEN f.sig <> r.saved AND f.sig = r.cand AND r.calm + 1 >= 2 THEN r.at ELSE -1 END
 FROM r JOIN f ON f.u = r.u AND f.seq = r.seq + 1)
SELECT u AS "user", n - 1 AS frame_id, hit AS global_idx FROM r WHERE hit >= 0""")
def stable(spark, sf):
    level = F.floor(F.col("y") / 40).cast("int") * 100
    frames = dense_events(spark, sf).select(
        "user", (F.col("pos") + 1).alias("seq"), F.lit(2.0).alias("fps"), F.array(level, level).alias("sig"))
    return fr.stable_frames(frames, ["user"], chunk_size=dense_size(spark, sf))


@query("t1_tumbling_windows", f"""WITH {EV}, w AS (SELECT u, x, CAST(floor((us - min(us) OVER (PARTITION BY u)) / 1e6 / 86400) AS BIGINT) AS win FROM ev)
SELECT u AS "user", win, count(*) AS n, round(sum(x), 4) AS total FROM w GROUP BY u, win""")
def tumbling_windows(spark, sf):
    from daytrace.operators.merge import tumbling

    rows = activity(spark, sf).withColumn("t", us("ts") / F.lit(1e6))
    return tumbling(rows, ["user"], 86400).groupBy("user", "win").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("x"), "total", 4))

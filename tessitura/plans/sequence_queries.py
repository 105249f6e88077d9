"""Queries of sequential features and joins by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators import sequence as q
from tessitura.operators.timejoin import augment
from tessitura.plans.history import SQL, history
from tessitura.tables import table

STREAM = q.Stream(["user_id"], "ts", "event_id", "artist", "skip")
SIZE = 100


NEEDED = ("user_id", "ts", "artist", "skip")


def sessions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """History with sessions: the columns of NEEDED and the given ones."""
    return q.sessionize(history(spark, folder, *NEEDED, *columns), STREAM)


def w1_w3_sessionize(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(spark, folder).select("event_id", F.round("time_diff", 6).alias("time_diff"), "session_id", "session_position", F.round("session_elapsed_seconds", 6).alias("session_elapsed_seconds"))


def w4_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return q.calendar_parts(history(spark, folder, "ts"), "ts").select("event_id", *(F.col(c).cast("long").alias(c) for c in ("hour", "dow", "month")), "hour_sin", "hour_cos", "dow_sin", "dow_cos")


def w5_w6_item_history(spark: SparkSession, folder: str) -> DataFrame:
    found = q.item_history(history(spark, folder, *NEEDED), STREAM)
    return found.select("event_id", "item_play_count", "hours_since_item", "plays_since_item", F.round("item_skip_rate", 9).alias("item_skip_rate"), F.round("item_skip_smooth", 9).alias("item_skip_smooth"))


def w7_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return q.streaks(history(spark, folder, *NEEDED), STREAM).select("event_id", "skip_streak", "listen_streak")


def w8_codes(spark: SparkSession, folder: str) -> DataFrame:
    return q.codes(history(spark, folder, "platform"), "platform", "platform_code").select("event_id", "platform_code")


def w9_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return q.vocabulary(history(spark, folder, "artist"), "artist", 50)


def w10_rolling_counts(spark: SparkSession, folder: str) -> DataFrame:
    return q.rolling_item_counts(history(spark, folder, *NEEDED), STREAM, {"plays_24h": 86_400, "plays_7d": 604_800}).select("event_id", "plays_24h", "plays_7d")


def w13_w16_session_so_far(spark: SparkSession, folder: str) -> DataFrame:
    found = q.session_so_far(sessions(spark, folder), STREAM)
    return found.select("event_id", "item_session_plays", F.round("session_skip_rate", 9).alias("session_skip_rate"), "session_unique_items", F.round("session_repeat_ratio", 9).alias("session_repeat_ratio"), "repeats_previous")


def w17_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return q.transitions_so_far(sessions(spark, folder), STREAM, SIZE).select("event_id", "transition_count", F.round("transition_rate", 9).alias("transition_rate"))


def w18_slot_rates(spark: SparkSession, folder: str) -> DataFrame:
    found = q.slot_rates(q.calendar_parts(history(spark, folder, *NEEDED), "ts"), STREAM)
    return found.select("event_id", F.round("item_hour_rate", 9).alias("item_hour_rate"), F.round("item_dow_rate", 9).alias("item_dow_rate"))


def w19_recent(spark: SparkSession, folder: str) -> DataFrame:
    found = q.recent(history(spark, folder, *NEEDED), STREAM)
    return found.select("event_id", *(F.round(f"recent_{n}_{k}", 9).alias(f"recent_{n}_{k}") for n in ("skip_rate", "unique_ratio") for k in (5, 20)))


def w31_windows(spark: SparkSession, folder: str) -> DataFrame:
    found = q.windows_before(sessions(spark, folder, "platform"), STREAM, 3, ["platform"])
    return found.select("event_id", F.concat_ws("|", "history").alias("history"), F.col("artist").alias("target"), "before_platform")


def w32_split(spark: SparkSession, folder: str) -> DataFrame:
    return q.split_by_boundaries(sessions(spark, folder), STREAM).select("event_id", "split")


def w33_examples(spark: SparkSession, folder: str) -> DataFrame:
    found = q.example_histories(sessions(spark, folder), STREAM, 4)
    return found.select("event_id", F.concat_ws("|", "history").alias("history"), F.round(F.aggregate("history_gaps", F.lit(0.0), lambda a, x: a + x), 6).alias("gap_sum"), "repeat", "session_end")


def j8_j10_time_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Plays with what the same device family of the user did before: last skipped milliseconds, milliseconds and ends of tracks of the last hour."""
    h = history(spark, folder, *NEEDED, "family", "media_type", "ms", "reason_end").withColumn("time_us", F.unix_micros("ts")).withColumn("seq", F.col("event_id"))
    plays = h.where("media_type = 'podcast'")
    music = h.where("media_type = 'music'")
    hour = 3_600_000_000
    found = augment(
        plays,
        {"skips": music.where("skip"), "music": music.withColumn("ended", (F.col("reason_end") == "trackdone").cast("int"))},
        ["user_id", "family"],
        "event_id",
        "time_us",
        latest={"last_skip_ms": ("skips", "ms")},
        sums={"ms_1h": ("music", "ms", hour), "ended_1h": ("music", "ended", hour)},
    )
    return found.select("event_id", "family", "last_skip_ms", "ms_1h", "ended_1h")


QUERIES = {f.__name__: f for f in (w1_w3_sessionize, w4_calendar, w5_w6_item_history, w7_streaks, w8_codes, w9_vocabulary, w10_rolling_counts, w13_w16_session_so_far, w17_transitions, w18_slot_rates, w19_recent, w31_windows, w32_split, w33_examples, j8_j10_time_joins)}

_H = f"WITH {SQL}"
_S = (
    _H
    + """, g AS (SELECT *, coalesce((us - lag(us) OVER w) / 1000000.0::DOUBLE, 0) AS time_diff FROM h WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s0 AS (SELECT *, CAST(sum(CASE WHEN time_diff > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM g),
s AS (SELECT *, row_number() OVER w - 1 AS session_position, (us - min(us) OVER (PARTITION BY user_id, session_id)) / 1000000.0::DOUBLE AS session_elapsed_seconds, lag(artist) OVER w AS prev FROM s0 WINDOW w AS (PARTITION BY user_id, session_id ORDER BY us, event_id))
"""
)
_FAMILY = "CASE WHEN regexp_matches(coalesce(platform, ''), 'ios|iphone|ipad|android|mobile|phone|tablet') THEN 'mobile' WHEN regexp_matches(coalesce(platform, ''), 'windows|mac|osx|linux|desktop|web') THEN 'desktop' ELSE 'other' END"
_PI = "6.283185307179586"

ORACLE = {
    "w1_w3_sessionize": _S + "SELECT event_id, round(time_diff, 6) AS time_diff, session_id, session_position, round(session_elapsed_seconds, 6) AS session_elapsed_seconds FROM s",
    "w4_calendar": _H
    + f""" SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS dow, month(ts) AS month, round(sin(hour(ts) * ({_PI}::DOUBLE / 24)), 9) AS hour_sin, round(cos(hour(ts) * ({_PI}::DOUBLE / 24)), 9) AS hour_cos,
  round(sin((isodow(ts) - 1) * ({_PI}::DOUBLE / 7)), 9) AS dow_sin, round(cos((isodow(ts) - 1) * ({_PI}::DOUBLE / 7)), 9) AS dow_cos FROM h""",
    "w5_w6_item_history": _H
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS row_idx FROM h),
x AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(sum(skip::INT) OVER (PARTITION BY user_id, artist ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
  lag(us) OVER w AS before, lag(row_idx) OVER w AS before_row FROM r WINDOW w AS (PARTITION BY user_id, artist ORDER BY us, event_id))
SELECT event_id, n AS item_play_count, coalesce(greatest((us - before) / 1000000.0::DOUBLE / 3600, 0), 0) AS hours_since_item, coalesce(row_idx - before_row, row_idx + 1) AS plays_since_item,
  round(CASE WHEN n > 0 THEN k::DOUBLE / n ELSE 0 END, 9) AS item_skip_rate, round((k + 1)::DOUBLE / (n + 2), 9) AS item_skip_smooth FROM x""",
    "w7_streaks": _H
    + """, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - row_number() OVER (PARTITION BY user_id, skip ORDER BY us, event_id) AS island FROM h),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id, skip, island ORDER BY us, event_id) - 1 AS i FROM f)
SELECT event_id, CASE WHEN skip THEN i ELSE 0 END AS skip_streak, CASE WHEN skip THEN 0 ELSE i END AS listen_streak FROM x""",
    "w8_codes": _H + ", v AS (SELECT platform, row_number() OVER (ORDER BY platform) - 1 AS code FROM (SELECT DISTINCT platform FROM h WHERE platform IS NOT NULL)) SELECT event_id, coalesce(code, -1) AS platform_code FROM h LEFT JOIN v USING (platform)",
    "w9_vocabulary": _H + ", t AS (SELECT artist, count(*) AS n FROM h GROUP BY artist ORDER BY n DESC, artist LIMIT 50) SELECT artist, n, row_number() OVER (ORDER BY artist) - 1 AS label FROM t",
    "w10_rolling_counts": _H
    + """, a AS (SELECT *, us // 1000000 AS s FROM h) SELECT x.event_id, count(y.event_id) FILTER (y.s >= x.s - 86400) AS plays_24h, count(y.event_id) AS plays_7d FROM a x
LEFT JOIN a y ON x.user_id = y.user_id AND x.artist = y.artist AND (y.us, y.event_id) < (x.us, x.event_id) AND y.s >= x.s - 604800 GROUP BY x.event_id""",
    "w13_w16_session_so_far": _S
    + """, i AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id, artist ORDER BY us, event_id) - 1 AS item_session_plays FROM s),
x AS (SELECT *, coalesce(sum(skip::INT) OVER b, 0) AS k, coalesce(sum((item_session_plays = 0)::INT) OVER b, 0) AS u FROM i WINDOW b AS (PARTITION BY user_id, session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, item_session_plays, round(CASE WHEN session_position > 0 THEN k::DOUBLE / session_position ELSE 0 END, 9) AS session_skip_rate, CAST(u AS BIGINT) AS session_unique_items,
  round(CASE WHEN session_position > 0 THEN (session_position - u)::DOUBLE / session_position ELSE 0 END, 9) AS session_repeat_ratio, coalesce((prev = artist)::INT, 0) AS repeats_previous FROM x""",
    "w17_transitions": _S
    + f"""SELECT event_id, CASE WHEN prev IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY user_id, prev, artist ORDER BY us, event_id) - 1 END AS transition_count,
  round(CASE WHEN prev IS NULL THEN 0 ELSE (row_number() OVER (PARTITION BY user_id, prev, artist ORDER BY us, event_id))::DOUBLE / (row_number() OVER (PARTITION BY user_id, prev ORDER BY us, event_id) - 1 + {SIZE}) END, 9) AS transition_rate FROM s""",
    "w18_slot_rates": _H
    + """ SELECT event_id, round((row_number() OVER (PARTITION BY user_id, artist, hour(ts) ORDER BY us, event_id))::DOUBLE / (row_number() OVER (PARTITION BY user_id, artist ORDER BY us, event_id) + 23), 9) AS item_hour_rate,
  round((row_number() OVER (PARTITION BY user_id, artist, isodow(ts) ORDER BY us, event_id))::DOUBLE / (row_number() OVER (PARTITION BY user_id, artist ORDER BY us, event_id) + 6), 9) AS item_dow_rate FROM h""",
    "w19_recent": _H
    + """ SELECT event_id, round(coalesce(avg(skip::INT) OVER a, 0), 9) AS recent_skip_rate_5, round(coalesce(avg(skip::INT) OVER b, 0), 9) AS recent_skip_rate_20,
  round(coalesce(len(list_distinct(list(artist) OVER a))::DOUBLE / count(*) OVER a, 0), 9) AS recent_unique_ratio_5, round(coalesce(len(list_distinct(list(artist) OVER b))::DOUBLE / nullif(count(*) OVER b, 0), 0), 9) AS recent_unique_ratio_20
FROM h WINDOW a AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "w31_windows": _S
    + """, x AS (SELECT *, lag(artist, 3) OVER w AS a3, lag(artist, 2) OVER w AS a2, lag(artist) OVER w AS a1, lag(platform) OVER w AS before_platform FROM s WINDOW w AS (PARTITION BY user_id, session_id ORDER BY us, event_id))
SELECT event_id, a3 || '|' || a2 || '|' || a1 AS history, artist AS target, before_platform FROM x WHERE session_position >= 3""",
    "w32_split": _S
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s),
c AS (SELECT user_id, n, arg_min(i, abs(i - n * 0.64::DOUBLE) + i * 1e-9::DOUBLE) FILTER (session_position = 0 AND i > 0) AS a, arg_min(i, abs(i - n * 0.8::DOUBLE) + i * 1e-9::DOUBLE) FILTER (session_position = 0 AND i > 0) AS b FROM r GROUP BY user_id, n)
SELECT event_id, CASE WHEN i < coalesce(a, r.n) THEN 'train' WHEN i < greatest(coalesce(a, r.n), coalesce(b, r.n)) THEN 'validation' ELSE 'test' END AS split FROM r JOIN c USING (user_id)""",
    "w33_examples": _S
    + """, x AS (SELECT *, list(artist) OVER f AS hist, list(time_diff) OVER f AS gaps, lead(event_id) OVER (PARTITION BY user_id, session_id ORDER BY us, event_id) IS NULL AS session_end FROM s
  WINDOW f AS (PARTITION BY user_id, session_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT event_id, array_to_string(hist, '|') AS history, round(list_sum(gaps) - gaps[1], 6) AS gap_sum, list_contains(hist, artist) AS repeat, session_end FROM x WHERE session_position > 0""",
    "j8_j10_time_joins": _H
    + f""", f AS (SELECT *, {_FAMILY} AS family FROM h), p AS (SELECT * FROM f WHERE media_type = 'podcast'), m AS (SELECT * FROM f WHERE media_type = 'music'),
a AS (SELECT p.event_id, arg_max(m.ms, (m.us, m.event_id))::DOUBLE AS last_skip_ms FROM p JOIN m ON m.user_id = p.user_id AND m.family = p.family AND m.skip AND m.us <= p.us GROUP BY 1),
b AS (SELECT p.event_id, sum(m.ms)::DOUBLE AS ms_1h, sum((m.reason_end = 'trackdone')::INT)::DOUBLE AS ended_1h FROM p JOIN m ON m.user_id = p.user_id AND m.family = p.family AND m.us BETWEEN p.us - 3600000000 AND p.us GROUP BY 1)
SELECT p.event_id, family, coalesce(last_skip_ms, 0) AS last_skip_ms, coalesce(ms_1h, 0) AS ms_1h, coalesce(ended_1h, 0) AS ended_1h FROM p LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""",
}

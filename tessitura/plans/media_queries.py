"""Queries of media, archetypes, splits by session, features of sequences, and technical logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators import features, media, sequence
from tessitura.plans.history import SQL, history
from tessitura.plans.sequence_queries import _S, STREAM, sessions
from tessitura.session import materialize
from tessitura.sources.technical import COLUMNS, technical_features
from tessitura.tables import table

NAMES = {"artist": "artist_name", "track": "master_metadata_track_name", "track_uri": "track_uri", "show": "episode_show_name", "episode": "episode_name", "episode_uri": "episode_uri"}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_events(sessions(spark, folder, "ms", *NAMES.values()), NAMES)


def p11_p12_media_events(spark: SparkSession, folder: str) -> DataFrame:
    h = media.media_events(history(spark, folder, "ms_played", "skipped", "reason_end", *NAMES.values()), NAMES)
    return h.select("event_id", "media_family", "node_key", "item_type", "item_key", media.skip_label(F.col("skipped"), F.col("reason_end")).cast("string").alias("skip"), media.listen_ms(F.col("ms_played")).alias("listened"))


def w28_media_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_transitions(_events(spark, folder), ["user_id", "session_id"], ["ts", "event_id"])


def _days(spark: SparkSession, folder: str) -> DataFrame:
    h = history(spark, folder, "user_id", "day", "ms", "skip", "shuffle", "offline", "track_uri", "artist")
    days = media.day_features(h, ["user_id", "day"])
    return media.archetypes(days.withColumns({c: F.round(c, 9) for c, t in days.dtypes if t == "double"}))


def a48_seasons(spark: SparkSession, folder: str) -> DataFrame:
    found = media.seasonal_summary(_days(spark, folder), "day")
    return _rounded(found.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")}))


def w27_archetype_steps(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(media.archetype_transitions(_days(spark, folder), ["user_id"], "day"))


def w34_session_split(spark: SparkSession, folder: str) -> DataFrame:
    return media.split_by_sessions(sessions(spark, folder).select("event_id", "user_id", "session_id"), ["user_id"], "session_id").select("event_id", "split")


def m28_sequence_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "track_reranking_split").groupBy("query_id").agg(F.max("candidate_item_ids").alias("items"))
    return _rounded(features.sequence_features(rows, "items").drop("items"))


def _histories(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.example_histories(sessions(spark, folder), STREAM, 6)


def m22_context(spark: SparkSession, folder: str) -> DataFrame:
    found = features.context_features(_histories(spark, folder), "history", "history_gaps", "session_position")
    return _rounded(found.select("event_id", "log_history", "unique_ratio", "repeat_ratio", "log_position", "log_mean_gap", "log_longest_gap", "log_last_gap"))


def m23_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The next item as candidate against the history before it."""
    found = features.candidate_features(_histories(spark, folder), "history", "artist")
    return _rounded(found.select("event_id", "occurrence_share", "in_history", "is_last", "in_last_3", "in_last_5", "recency"))


def m26_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of pretraining pairs of each objective."""
    rows, found = _histories(spark, folder).select("history"), None
    for objective in ("masked_tail", "neighbours", "contrastive"):
        part = features.pretraining_pairs(rows, "history", objective, 3).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n")).withColumn("objective", F.lit(objective))
        found = part if found is None else found.unionByName(part)
    return found


def m25_session_vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select((F.col("vec_id") / 5).cast("long").alias("session"), (F.col("vec_id") % 5).alias("position"), F.slice("embedding", 1, 8).alias("v"))
    found = features.session_vectors(e, "session", "position", "v")
    return found.select("session", *(F.round(F.element_at("vector", i + 1), 9).alias(f"v{i}") for i in range(8)))


def _logs(h: DataFrame) -> dict[str, DataFrame]:
    """Technical logs: of the history h, plays as connection reports, shuffled ones as settings, and ends of tracks as errors, stutter and tracks not played."""
    h = h.withColumns({"context_time": F.unix_millis("ts"), "context_os_name": F.col("platform")})
    reach = F.when(F.col("conn_country") == "US", "wlan").when(F.col("conn_country").isNull(), "none").otherwise("4g")
    return {
        "ConnectionInfo.json": h.withColumns({"message_reachability_type": reach, "message_ipv6_failed": F.col("offline").cast("string")}),
        "AudioStreamingSettingsReport.json": h.where("shuffle").withColumns({"message_allow_downgrade": F.lit("yes"), "message_play_bitrate_wifi": F.col("ms_played") % 320_000, "message_user_selected_play_bitrate_cellular": F.lit(96_000)}),
        "PlaybackError.json": h.where("reason_end = 'trackerror'").withColumn("message_fatal", F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")),
        "Stutter.json": h.where("reason_end = 'backbtn'"),
        "TrackNotPlayed.json": h.where("reason_end = 'remote'"),
        "CloudPlaybackPlaybackStats.json": h.where("event_id % 3 = 0").withColumn("message_num_stalls", F.col("event_id") % 5),
    }


def j10_technical_features(spark: SparkSession, folder: str) -> DataFrame:
    h = materialize(history(spark, folder, "ts", "platform", "media_type", "conn_country", "shuffle", "offline", "reason_end", "ms_played"), "plays")
    plays = h.select("event_id", "ts", "platform", "media_type").where("media_type = 'podcast'")
    return technical_features(plays, "event_id", "ts", "platform", _logs(h)).select("event_id", *(F.round(c, 6).alias(c) for c in COLUMNS))


QUERIES = {f.__name__: f for f in (p11_p12_media_events, w28_media_transitions, a48_seasons, w27_archetype_steps, w34_session_split, m28_sequence_features, m22_context, m23_candidates, m26_pairs, m25_session_vectors, j10_technical_features)}
QUERIES = {{"p11_p12_media_events": "media_events"}.get(n, n): f for n, f in QUERIES.items()}

_TRIM = lambda c: f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_CLEAN = lambda c: f"CASE WHEN lower({_TRIM(c)}) NOT IN ('', 'nan', 'none', 'null') THEN {_TRIM(c)} END"
_HX = SQL.replace("episode_uri,", "episode_uri, episode_name, episode_show_name, master_metadata_track_name, skipped, ms_played,")
_M = f""", cl AS (SELECT *, {_CLEAN("artist_name")} AS ar, {_CLEAN("master_metadata_track_name")} AS tr, {_CLEAN("track_uri")} AS tu, {_CLEAN("episode_show_name")} AS sh, {_CLEAN("episode_name")} AS ep, {_CLEAN("episode_uri")} AS eu FROM _RAW_),
me AS (SELECT *, CASE WHEN coalesce(sh, ep, eu) IS NOT NULL THEN 'podcast' ELSE 'music' END AS media_family, CASE WHEN coalesce(sh, ep, eu) IS NOT NULL THEN 'show:' || lower(coalesce(sh, ep, eu)) ELSE 'artist:' || lower(coalesce(ar, tr, tu)) END AS node_key,
  CASE WHEN coalesce(sh, ep, eu) IS NOT NULL THEN CASE WHEN ep IS NOT NULL THEN 'episode' ELSE 'show' END ELSE CASE WHEN tr IS NOT NULL THEN 'track' ELSE 'artist' END END AS item_type,
  CASE WHEN coalesce(sh, ep, eu) IS NOT NULL THEN coalesce(eu, lower(coalesce(ep, sh, eu))) ELSE coalesce(tu, lower(coalesce(tr, ar, tu))) END AS item_id FROM cl WHERE coalesce(sh, ep, eu, ar, tr, tu) IS NOT NULL)
"""
_SX = _S.replace(SQL, _HX)
_DAYS = f"""WITH {SQL}, d AS (SELECT user_id, day, count(*) AS total_streams, round(sum(ms) / 3600000.0::DOUBLE, 9) AS engagement_hours, round(avg(skip::INT), 9) AS skip_rate, round(coalesce(avg(shuffle::INT), 0), 9) AS shuffle_rate, round(coalesce(avg(offline::INT), 0), 9) AS offline_rate, round(avg((track_uri IS NOT NULL)::INT), 9) AS track_stream_share,
  round(count(DISTINCT artist)::DOUBLE / count(*), 9) AS exploration_ratio, round(1 - count(DISTINCT artist)::DOUBLE / count(*), 9) AS repeat_intensity FROM h GROUP BY 1, 2),
q AS (SELECT quantile_cont(skip_rate, 0.75) AS sh, quantile_cont(offline_rate, 0.75) AS oh, quantile_cont(exploration_ratio, 0.75) AS eh, quantile_cont(shuffle_rate, 0.5) AS um, quantile_cont(repeat_intensity, 0.5) AS rm, quantile_cont(total_streams::DOUBLE, 0.25) AS tl FROM d),
a AS (SELECT d.*, CASE WHEN track_stream_share <= 0.6 THEN 'mixed_media_reset' WHEN offline_rate >= greatest(0.15, oh) THEN 'offline_binge' WHEN skip_rate >= sh AND shuffle_rate >= um THEN 'skip_surfing' WHEN exploration_ratio >= eh AND shuffle_rate >= um THEN 'exploratory_shuffle' WHEN repeat_intensity >= rm AND shuffle_rate < um AND skip_rate < sh THEN 'steady_replay'
  WHEN total_streams <= tl THEN 'quick_check_in' ELSE 'steady_listening' END AS archetype_label FROM d, q)
"""
_X = (
    _S
    + """, x AS (SELECT *, list(artist) OVER w AS hist, list(time_diff) OVER w AS g0 FROM s WINDOW w AS (PARTITION BY user_id, session_id ORDER BY us, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, list_transform(g0, lambda v, i: CASE WHEN i = 1 THEN 0 ELSE v END) AS gaps, list_filter(list_transform(g0, lambda v, i: CASE WHEN i = 1 THEN 0 ELSE v END), lambda v: v > 0) AS pos, list_reverse(hist) AS back FROM x WHERE session_position > 0)
"""
)
_FAM = "CASE WHEN regexp_matches(coalesce(platform, ''), 'ios|iphone|ipad|android|mobile|phone|tablet') THEN 'mobile' WHEN regexp_matches(coalesce(platform, ''), 'windows|mac|osx|linux|desktop|web') THEN 'desktop' ELSE 'other' END"
_PAIRS = {
    "masked_tail": "SELECT event_id, v AS l, back[1] AS r FROM (SELECT event_id, back, unnest(list_distinct(back[2:4])) AS v FROM y WHERE len(back) >= 2) WHERE v <> back[1]",
    "contrastive": "SELECT a.event_id, a.v AS l, b.v AS r FROM (SELECT event_id, unnest(list_distinct(back)) AS v FROM y WHERE len(back) >= 2) a JOIN (SELECT event_id, unnest(list_distinct(back)) AS v FROM y WHERE len(back) >= 2) b ON a.event_id = b.event_id AND a.v <> b.v",
}
_PAIRS["neighbours"] = f"SELECT * FROM ({_PAIRS['masked_tail']}) UNION ALL SELECT event_id, r, l FROM ({_PAIRS['masked_tail']})"


def _window(values: str, hours: int, where: str = "true", family: bool = True) -> str:
    keys = "PARTITION BY fam " if family else ""
    return f"coalesce(sum(CASE WHEN side = 0 AND {where} THEN {values} END) OVER ({keys}ORDER BY ms_ RANGE BETWEEN {hours * 3_600_000} PRECEDING AND CURRENT ROW), 0)"


def _last(value: str, where: str = "true") -> str:
    return f"coalesce(last_value(CASE WHEN side = 0 AND {where} THEN {value} END IGNORE NULLS) OVER (PARTITION BY fam ORDER BY ms_, side, event_id ROWS UNBOUNDED PRECEDING), 0)"


_TECH = {
    "tech_connection_events_1h": _window("1", 1),
    "tech_connection_none_24h": _window("(conn_country IS NULL)::INT", 24),
    "tech_ipv6_failures_24h": _window("coalesce(offline, false)::INT", 24),
    "tech_playback_errors_24h": _window("1", 24, "reason_end = 'trackerror'"),
    "tech_playback_fatal_errors_24h": _window("(event_id % 2 = 0)::INT", 24, "reason_end = 'trackerror'"),
    "tech_stutter_events_24h": _window("1", 24, "reason_end = 'backbtn'"),
    "tech_track_not_played_24h": _window("1", 24, "reason_end = 'remote'"),
    "tech_cloud_stats_events_24h": _window("1", 24, "event_id % 3 = 0", False),
    "tech_cloud_stalls_24h": _window("event_id % 5", 24, "event_id % 3 = 0", False),
    "tech_last_reachability_wifi": _last("(conn_country IS NOT DISTINCT FROM 'US')::INT"),
    "tech_last_reachability_cellular": _last("(conn_country IS NOT NULL AND conn_country <> 'US')::INT"),
    "tech_last_reachability_offline": _last("(conn_country IS NULL)::INT"),
    "tech_last_ipv6_failed": _last("coalesce(offline, false)::INT"),
    "tech_allow_downgrade": _last("1", "shuffle"),
    "tech_bitrate_wifi_kbps": _last("coalesce(ms_played % 320000, 0) / 1000.0::DOUBLE", "shuffle"),
    "tech_bitrate_cellular_kbps": _last("96", "shuffle"),
}

ORACLE = {
    "media_events": f"WITH {_HX}" + _M.replace("_RAW_", "h") + """SELECT event_id, media_family, node_key, item_type, item_type || ':' || item_id AS item_key, CASE WHEN lower(trim(skipped)) IN ('true', '1', 'yes', 'y', 't') THEN 'true' WHEN lower(trim(skipped)) IN ('false', '0', 'no', 'n', 'f') THEN 'false' WHEN lower(trim(reason_end)) IN ('fwdbtn', 'backbtn') THEN 'true' WHEN lower(trim(reason_end)) = 'trackdone' THEN 'false' END AS skip,
  CASE WHEN ms_played >= 0 THEN ms_played END AS listened FROM me""",
    "w28_media_transitions": _SX
    + _M.replace("_RAW_", "s")
    + """, b AS (SELECT *, lag(node_key) OVER w AS sk, lag(media_family) OVER w AS sf FROM me WINDOW w AS (PARTITION BY user_id, session_id ORDER BY us, event_id))
SELECT sk AS source_key, sf AS source_family, node_key AS target_key, media_family AS target_family, count(*) AS transition_count, CAST(sum(ms) AS BIGINT) AS target_ms, sf <> media_family AS cross_media FROM b WHERE sk IS NOT NULL AND sk <> node_key GROUP BY ALL""",
    "a48_seasons": _DAYS
    + """, p AS (SELECT *, year(day) + (month(day) = 12)::INT AS season_year, CASE WHEN month(day) IN (12, 1, 2) THEN 'winter' WHEN month(day) <= 5 THEN 'spring' WHEN month(day) <= 8 THEN 'summer' ELSE 'fall' END AS season FROM a)
SELECT season_year, season, archetype_label, count(*) AS day_count, round(avg(total_streams), 9) AS mean_streams, round(avg(skip_rate), 9) AS mean_skip_rate, round(avg(exploration_ratio), 9) AS mean_exploration_ratio, CAST(min(day) AS VARCHAR) AS start_date, CAST(max(day) AS VARCHAR) AS end_date, round(count(*) / sum(count(*)) OVER (PARTITION BY season_year, season)::DOUBLE, 9) AS archetype_share FROM p GROUP BY 1, 2, 3""",
    "w27_archetype_steps": _DAYS
    + """, n AS (SELECT archetype_label AS from_archetype, lead(archetype_label) OVER (PARTITION BY user_id ORDER BY day) AS to_archetype FROM a)
SELECT from_archetype, to_archetype, count(*) AS transition_count, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS transition_share FROM n WHERE to_archetype IS NOT NULL GROUP BY 1, 2""",
    "w34_session_split": _S
    + """, z AS (SELECT user_id, session_id, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS c, sum(n) OVER (PARTITION BY user_id) AS a, count(*) OVER (PARTITION BY user_id) AS m FROM z WINDOW w AS (PARTITION BY user_id ORDER BY session_id)),
t AS (SELECT user_id, arg_min(k, (abs(c - a * 0.64::DOUBLE), k)) FILTER (k <= m - 2) AS t FROM k GROUP BY 1), v AS (SELECT k.user_id, arg_min(k.k, (abs(c - a * 0.8::DOUBLE), k.k)) FILTER (k.k > t AND k.k <= m - 1) AS v FROM k JOIN t USING (user_id) GROUP BY 1)
SELECT event_id, CASE WHEN m = 1 THEN 'train' WHEN m = 2 THEN CASE WHEN k = 1 THEN 'train' ELSE 'test' END WHEN k <= t THEN 'train' WHEN k <= v THEN 'validation' ELSE 'test' END AS split FROM s JOIN k USING (user_id, session_id) JOIN t USING (user_id) JOIN v USING (user_id)""",
    "m28_sequence_features": """WITH q AS (SELECT query_id, max(candidate_item_ids) AS i FROM track_reranking_split GROUP BY 1), r AS (SELECT query_id, i, list_reverse(i) AS b, len(i) AS n FROM q WHERE len(i) > 0 AND len(list_filter(i, lambda x: x IS NULL)) = 0)
SELECT query_id, b[1] AS last, b[least(n, 2)] AS previous, i[1] AS first, round(list_avg(list_transform(i, lambda x: x::DOUBLE)), 9) AS mean, round(list_stddev_pop(list_transform(i, lambda x: x::DOUBLE)), 9) AS deviation, round(len(list_distinct(i))::DOUBLE / n, 9) AS unique_ratio, coalesce(list_min(list_filter(list_transform(b, lambda x, k: CASE WHEN x <> i[-1] THEN k - 1 END), lambda x: x IS NOT NULL)), n) AS end_run,
  CASE WHEN n > 1 THEN (b[1] = b[2])::INT ELSE 1 END AS repeats, round(len(list_distinct(b[1:5]))::DOUBLE / len(b[1:5]), 9) AS recent_unique_ratio FROM r""",
    "m22_context": _X
    + """SELECT event_id, round(ln(1 + len(hist)), 9) AS log_history, round(len(list_distinct(hist))::DOUBLE / len(hist), 9) AS unique_ratio, round(1 - len(list_distinct(hist))::DOUBLE / len(hist), 9) AS repeat_ratio, round(ln(1 + session_position), 9) AS log_position, round(ln(1 + coalesce(list_sum(pos) / nullif(len(pos), 0), 0)), 9) AS log_mean_gap, round(ln(1 + coalesce(list_max(pos), 0)), 9) AS log_longest_gap, round(ln(1 + greatest(gaps[-1], 0)), 9) AS log_last_gap FROM y""",
    "m23_candidates": _X
    + """SELECT event_id, round(len(list_filter(hist, lambda v: v = artist))::DOUBLE / len(hist), 9) AS occurrence_share, list_contains(hist, artist)::INT AS in_history, (back[1] = artist)::INT AS is_last, list_contains(back[1:3], artist)::INT AS in_last_3, list_contains(back[1:5], artist)::INT AS in_last_5, round(coalesce(1.0::DOUBLE / nullif(list_position(back, artist), 0), 0), 9) AS recency FROM y""",
    "m26_pairs": _X + " UNION ALL ".join(f"SELECT l AS \"left\", r AS \"right\", count(*) AS n, '{o}' AS objective FROM ({q}) GROUP BY 1, 2" for o, q in _PAIRS.items()),
    "m25_session_vectors": "WITH e AS (SELECT vec_id // 5 AS session, vec_id % 5 AS p, embedding AS v FROM embeddings), l AS (SELECT *, 1 + coalesce(p / nullif(max(p) OVER (PARTITION BY session), 0)::DOUBLE, 0) AS w FROM e) SELECT session, " + ", ".join(f"round(sum(w * v[{i + 1}]::DOUBLE) / sum(w), 9) AS v{i}" for i in range(8)) + " FROM l GROUP BY session",
    "j10_technical_features": f"WITH {SQL.replace('episode_uri,', 'episode_uri, ms_played,')}, u AS (SELECT *, us // 1000 AS ms_, {_FAM} AS fam, 0 AS side FROM h UNION ALL SELECT *, us // 1000, {_FAM}, 1 FROM h WHERE media_type = 'podcast'), r AS (SELECT event_id, side, " + ", ".join(f"round(({x})::DOUBLE, 6) AS {n}" for n, x in _TECH.items()) + " FROM u) SELECT * EXCLUDE (side) FROM r WHERE side = 1",
}

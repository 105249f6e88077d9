"""Queries of aggregates, ranks, similarity and trends over the listening tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import LISTED_SQL, leading, listed, similarity_label
from tessitura.operators import graph, relations, similarity
from tessitura.operators.quality import history_quality
from tessitura.plans.history import SQL, history
from tessitura.plans.sequence_queries import sessions
from tessitura.tables import table


def daily_activity(h: DataFrame) -> DataFrame:
    """Per day: plays, time, different artists and tracks, shares, and the most frequent platform (of equals the smallest).

    One pass: rows are added up by day and value of artist, track and platform at once (the values of a day are spread
    over the tasks), and the values of each day are then counted.
    """
    flags = {"skip_share": "skip", "shuffle_share": "shuffle", "offline_share": "offline"}
    known = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).cast("long")
    per = h.groupBy("day", "artist", "track_uri", "platform").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"), *(x for s, c in flags.items() for x in (F.sum(known(c)).alias(f"{s}_yes"), F.count(c).alias(f"{s}_of")))
    )
    sums = ["n", "ms", *(f"{s}_{x}" for s in flags for x in ("yes", "of"))]
    kinds = [("artist", F.nullif("artist", F.lit(""))), ("track", F.col("track_uri")), ("platform", F.col("platform"))]
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds)))
    counted = per.select("day", values.alias("v"), *sums).groupBy("day", "v.kind", "v.value").agg(*(F.sum(c).alias(c) for c in sums))
    of = lambda kind: F.col("kind") == kind
    total = lambda c: F.sum(F.when(of("artist"), F.col(c)))
    share = lambda part, whole: F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 9)
    best = F.min(F.when(of("platform") & F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))))["v"]
    return counted.groupBy("day").agg(
        total("n").alias("plays"),
        total("ms").alias("ms"),
        F.count(F.when(of("artist"), F.col("value"))).alias("artists"),
        F.count(F.when(of("track"), F.col("value"))).alias("tracks"),
        *(share(total(f"{s}_yes"), total(f"{s}_of")).alias(s) for s in flags),
        share(F.sum(F.when(of("track") & F.col("value").isNotNull(), F.col("n")).otherwise(0)), total("n")).alias("track_share"),
        best.alias("platform"),
    )


def a1_daily_activity(spark: SparkSession, folder: str) -> DataFrame:
    h = history(spark, folder, "day", "artist", "track_uri", "platform", "ms", "skip", "shuffle", "offline")
    return daily_activity(h).withColumn("day", F.col("day").cast("string"))


def a3_first_seen_mode(spark: SparkSession, folder: str) -> DataFrame:
    return relations.first_seen_mode(history(spark, folder, "user_id", "conn_country"), ["user_id"], "conn_country", "event_id", "country")


def a16_weighted_score(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted mean of three scores with missing ones as 0, and the one that leads."""
    c = table(spark, folder, "creator_ranking_opportunities").dropDuplicates(["opportunity_id"])
    names, weights = ["fan_migration_score", "local_gap_score", "scene_momentum_score"], [0.5, 0.3, 0.2]
    score = sum((F.coalesce(F.nanvl(F.col(n), F.lit(None)), F.lit(0.0)) * w for n, w in zip(names, weights)), F.lit(0.0))
    return c.select("opportunity_id", F.round(score, 6).alias("score"), leading(names, weights).alias("driver"))


def a23_ranked_artists(spark: SparkSession, folder: str) -> DataFrame:
    h = history(spark, folder, "user_id", "media_type", "artist", "ms").where("media_type = 'music' and artist <> ''")
    return similarity.ranked_entities(h, ["user_id"], "artist", "ms").where("rank <= 10").select("user_id", "artist", "n", "ms", "rank")


def daily_similarity(events: DataFrame, public: DataFrame, edition: int = 2024) -> DataFrame:
    """Per day: rank-weighted Jaccard similarity of its artists with both public lists, and how many artists they share."""
    h = events.where("media_type = 'music' and artist <> ''")
    mine = similarity.ranked_entities(h, ["day"], "artist", "ms")
    listed_ = public.where((F.col("dimension") == "artists") & (F.col("edition") == edition)).withColumn("artist", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")).where("artist <> ''")
    found = None
    for scope in ("global", "united_states"):
        ranks = listed_.where(F.col("list_scope") == scope).groupBy("artist").agg(F.min("list_rank").alias("rank"))
        part = similarity.rank_weighted_jaccard(mine, ranks, ["day"], "artist").select("day", F.col("similarity").alias(scope), F.col("shared").alias(f"{scope}_shared"))
        found = part if found is None else found.join(part, "day", "full_outer")
    return found


def _daily_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return daily_similarity(history(spark, folder, "day", "media_type", "artist", "ms"), table(spark, folder, "public_listening_row"))


def a25_a29_daily_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Rank-weighted Jaccard similarity of each day with both public lists, their difference and the closer one."""
    d = _daily_similarity(spark, folder).withColumn("difference", F.round(F.col("united_states") - F.col("global"), 9)).withColumn("label", similarity_label(F.greatest("global", "united_states")))
    return similarity.closer_streaks(d, [], "day", "global", "united_states", ("global", "united_states")).withColumn("day", F.col("day").cast("string"))


def w23_w24_trends(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.trailing_trend(_daily_similarity(spark, folder), [], "day", "global").drop("global_shared", "united_states_shared", "united_states").withColumn("day", F.col("day").cast("string"))


def w26_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    daily = table(spark, folder, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    found = similarity.deviations(daily, ["o_orderpriority"], "day", "total", least=10, limit=2.5)
    return found.select("o_orderpriority", F.col("day").cast("string").alias("day"), F.round("z", 6).alias("z"), "is_anomaly")


def a33_weekly_mean(spark: SparkSession, folder: str) -> DataFrame:
    daily = history(spark, folder, "user_id", "day", "skip").groupBy("user_id", "day").agg(F.avg(F.col("skip").cast("int")).alias("skip_rate"), F.count(F.lit(1)).alias("plays"))
    return similarity.weekly_mean(daily, ["user_id"], "day", "skip_rate", "plays").withColumn("week", F.col("week").cast("string"))


def a27_media_mix(spark: SparkSession, folder: str) -> DataFrame:
    h = history(spark, folder, "user_id", "media_type", "ms")
    one = lambda m: F.round(F.avg((F.col("media_type") == m).cast("int")), 9).alias(f"{m}_share")
    return h.groupBy("user_id").agg(one("music"), one("podcast"), one("other"), F.round(F.sum(F.when(F.col("media_type") == "music", F.col("ms")).otherwise(0)) / F.nullif(F.sum("ms"), F.lit(0)), 9).alias("music_time_share"))


def a32_fractional_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of opportunities spread evenly over the seed artists they name."""
    c = table(spark, folder, "creator_ranking_opportunities").dropDuplicates(["opportunity_id"]).withColumn("one", F.lit(1))
    tags = c.select("opportunity_id", F.explode(listed(F.col("dominant_release_labels"))).alias("label"))
    return similarity.fractional_shares(c, tags, "opportunity_id", "label", "scene_name", "days_since_latest_release")


def a36_min_max(spark: SparkSession, folder: str) -> DataFrame:
    found = relations.scaled(table(spark, folder, "supplier"), {"s_acctbal": True})
    return found.withColumn("nation_norm", relations.min_max("s_acctbal", ["s_nationkey"], higher_is_better=False)).select("s_suppkey", F.round("norm_s_acctbal", 9).alias("norm"), F.round("nation_norm", 9).alias("nation_norm"))


def a45_quality(spark: SparkSession, folder: str) -> DataFrame:
    return history_quality(table(spark, folder, "streaming_history"), "artist_name", "ts", "ms_played", ["skipped", "shuffle", "offline"])


def a49_regime_shifts(spark: SparkSession, folder: str) -> DataFrame:
    monthly = history(spark, folder, "day", "platform").where("platform is not null").groupBy(F.date_format("day", "yyyy-MM").alias("month"), "platform").agg(F.count(F.lit(1)).alias("n"))
    return similarity.regime_shifts(monthly, "month", "platform", "n")


def a50_mean_spread(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "customer").groupBy("c_mktsegment", "c_nationkey").agg(*relations.mean_spread("c_acctbal"))
    return found.select("c_mktsegment", "c_nationkey", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "ci95")))


def w20_rank_present(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "creator_ranking_opportunities").dropDuplicates(["opportunity_id"]).withColumn("score", F.nanvl("opportunity_score", F.lit(None)))
    return relations.rank_present(c, ["report_family_id"], "score", "place").select("opportunity_id", F.coalesce("place", F.lit(0)).alias("place"))


def w21_top_one(spark: SparkSession, folder: str) -> DataFrame:
    return relations.top_one(table(spark, folder, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


def w28_w29_transitions(spark: SparkSession, folder: str) -> DataFrame:
    h = history(spark, folder, "user_id", "ts", "artist").where("artist <> ''")
    return graph.transitions(h, ["user_id"], ["ts", "event_id"], "artist").where("n >= 2")


def w28_w29_session_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """All artist transitions within one session, also those seen once."""
    h = sessions(spark, folder, "artist").where("artist <> ''")
    return graph.transitions(h, ["user_id", "session_id"], ["ts", "event_id"], "artist")


def w30_node_profile(spark: SparkSession, folder: str) -> DataFrame:
    h = history(spark, folder, "user_id", "ts", "platform").where("platform is not null")
    return graph.node_profile(graph.transitions(h, ["user_id"], ["ts", "event_id"], "platform", allow_same=True), 12)


def w30_artist_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Degrees and entropy of every artist, of steps within one session."""
    h = sessions(spark, folder, "artist").where("artist <> ''")
    return graph.degree_profile(graph.transitions(h, ["user_id", "session_id"], ["ts", "event_id"], "artist", allow_same=True), h, "artist")


def w36_snapshot_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Latest order per customer and day, and its change against the one before."""
    latest = relations.top_one(table(spark, folder, "orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey", "day"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    w = Window.partitionBy("o_custkey").orderBy("day")
    return latest.select("o_custkey", F.col("day").cast("string").alias("day"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 4).alias("delta"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_daily_activity, a3_first_seen_mode, a16_weighted_score, a23_ranked_artists, a25_a29_daily_similarity, w23_w24_trends, w26_anomalies, a33_weekly_mean, a27_media_mix, a32_fractional_shares, a36_min_max, a45_quality, a49_regime_shifts,
        a50_mean_spread, w20_rank_present, w21_top_one, w28_w29_transitions, w28_w29_session_transitions, w30_node_profile, w30_artist_profile, w36_snapshot_deltas,
    )
}

_H = f"WITH {SQL}"
_C = "c AS (SELECT DISTINCT * EXCLUDE (generated_at) FROM creator_ranking_opportunities QUALIFY row_number() OVER (PARTITION BY opportunity_id) = 1)"
_D = (
    _H
    + """, t AS (SELECT day, artist, count(*) AS n, sum(ms) AS ms FROM h WHERE media_type = 'music' AND artist <> '' GROUP BY ALL),
r AS (SELECT day, artist, 1.0::DOUBLE / row_number() OVER (PARTITION BY day ORDER BY n DESC, ms DESC, artist) AS w FROM t),
p AS (SELECT list_scope AS scope, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS artist, 1.0::DOUBLE / min(list_rank) AS w FROM public_listening_row WHERE dimension = 'artists' AND edition = 2024 GROUP BY ALL HAVING regexp_replace(lower(name), '[^a-z0-9]', '', 'g') <> ''),
d AS (SELECT DISTINCT day, scope FROM r, (SELECT DISTINCT scope FROM p)),
u AS (SELECT d.day, d.scope, k.artist, coalesce(r.w, 0) AS a, coalesce(p.w, 0) AS b FROM d JOIN (SELECT day, NULL AS scope, artist FROM r UNION SELECT NULL, scope, artist FROM p) k ON k.day = d.day OR k.scope = d.scope
  LEFT JOIN r ON r.day = d.day AND r.artist = k.artist LEFT JOIN p ON p.scope = d.scope AND p.artist = k.artist GROUP BY ALL),
j AS (SELECT day, scope, round(sum(least(a, b)) / sum(greatest(a, b)), 9) AS s, count(*) FILTER (a > 0 AND b > 0) AS shared FROM u GROUP BY ALL),
y AS (SELECT day, max(s) FILTER (scope = 'global') AS global, max(shared) FILTER (scope = 'global') AS global_shared, max(s) FILTER (scope = 'united_states') AS united_states, max(shared) FILTER (scope = 'united_states') AS united_states_shared FROM j GROUP BY day)
"""
)

_X = (
    _H
    + """, g AS (SELECT *, coalesce((us - lag(us) OVER w) / 1000000.0::DOUBLE, 0) AS gap FROM h WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s0 AS (SELECT *, sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session_id FROM g), s1 AS (SELECT * FROM s0 WHERE artist <> ''), a AS (SELECT DISTINCT artist FROM s1),
p AS (SELECT lag(artist) OVER (PARTITION BY user_id, session_id ORDER BY us, event_id) AS source, artist AS target FROM s1), e AS (SELECT source, target, count(*) AS n FROM p WHERE source IS NOT NULL GROUP BY 1, 2)
"""
)

ORACLE = {
    "a1_daily_activity": _H
    + """, m AS (SELECT day, platform FROM h WHERE platform IS NOT NULL GROUP BY day, platform QUALIFY row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, platform) = 1),
g AS (SELECT day, count(*) AS plays, CAST(sum(ms) AS BIGINT) AS ms, count(DISTINCT nullif(artist, '')) AS artists, count(DISTINCT track_uri) AS tracks, round(avg(skip::INT), 9) AS skip_share, round(coalesce(avg(shuffle::INT), 0), 9) AS shuffle_share,
  round(coalesce(avg(offline::INT), 0), 9) AS offline_share, round(avg((track_uri IS NOT NULL)::INT), 9) AS track_share FROM h GROUP BY day)
SELECT g.* REPLACE (CAST(day AS VARCHAR) AS day), platform FROM g LEFT JOIN m USING (day)""",
    "a3_first_seen_mode": _H
    + """, c AS (SELECT user_id, trim(conn_country) AS v, count(*) AS n, min(event_id) AS seen FROM h GROUP BY ALL), k AS (SELECT user_id, v, CASE WHEN coalesce(v, '') = '' THEN 0 ELSE n END AS n, seen FROM c)
SELECT user_id, CASE WHEN n > 0 THEN v ELSE '' END AS country FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1""",
    "a16_weighted_score": f"WITH {_C}"
    + """, v AS (SELECT opportunity_id, CASE WHEN isnan(fan_migration_score) THEN NULL ELSE fan_migration_score END AS f, CASE WHEN isnan(local_gap_score) THEN NULL ELSE local_gap_score END AS l, CASE WHEN isnan(scene_momentum_score) THEN NULL ELSE scene_momentum_score END AS s FROM c)
SELECT opportunity_id, round(coalesce(f, 0) * 0.5::DOUBLE + coalesce(l, 0) * 0.3::DOUBLE + coalesce(s, 0) * 0.2::DOUBLE, 6) AS score,
  CASE WHEN f IS NULL AND l IS NULL AND s IS NULL THEN NULL WHEN coalesce(f * 0.5::DOUBLE, -1e9) >= greatest(coalesce(l * 0.3::DOUBLE, -1e9), coalesce(s * 0.2::DOUBLE, -1e9)) THEN 'fan_migration_score' WHEN coalesce(l * 0.3::DOUBLE, -1e9) >= coalesce(s * 0.2::DOUBLE, -1e9) THEN 'local_gap_score' ELSE 'scene_momentum_score' END AS driver FROM v""",
    "a23_ranked_artists": _H + ", t AS (SELECT user_id, artist, count(*) AS n, CAST(sum(ms) AS BIGINT) AS ms FROM h WHERE media_type = 'music' AND artist <> '' GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, ms DESC, artist) AS rank FROM t QUALIFY rank <= 10",
    "a25_a29_daily_similarity": _D
    + """, x AS (SELECT *, CASE WHEN global > united_states THEN 'global' WHEN global < united_states THEN 'united_states' ELSE 'tie' END AS closer FROM y),
i AS (SELECT *, (day - date '1970-01-01') - row_number() OVER (PARTITION BY closer ORDER BY day) AS island FROM x)
SELECT CAST(day AS VARCHAR) AS day, global, global_shared, united_states, united_states_shared, round(united_states - global, 9) AS difference,
  CASE WHEN greatest(global, united_states) >= 0.5 THEN 'strong' WHEN greatest(global, united_states) >= 0.25 THEN 'moderate' WHEN greatest(global, united_states) >= 0.1 THEN 'light' ELSE 'distinct' END AS label, closer,
  CASE WHEN closer = 'tie' THEN 0 ELSE row_number() OVER (PARTITION BY closer, island ORDER BY day) END AS streak FROM i""",
    "w23_w24_trends": _D
    + """SELECT CAST(a.day AS VARCHAR) AS day, any_value(a.global) AS global, round(avg(b.global) FILTER (b.day > a.day - 7), 12) AS global_mean_7d, round(stddev_pop(b.global) FILTER (b.day > a.day - 7), 12) AS global_std_7d,
  round(avg(b.global) FILTER (b.day > a.day - 30), 12) AS global_mean_30d, round(stddev_pop(b.global) FILTER (b.day > a.day - 30), 12) AS global_std_30d, round(any_value(a.global) - max(b.global) FILTER (b.day = a.day - 1), 9) AS global_delta_1d,
  round(any_value(a.global) - max(b.global) FILTER (b.day = a.day - 7), 9) AS global_delta_7d, round(any_value(a.global) - max(b.global) FILTER (b.day = a.day - 30), 9) AS global_delta_30d FROM y a JOIN y b ON b.day BETWEEN a.day - 30 AND a.day GROUP BY a.day""",
    "w26_anomalies": """
WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL),
m AS (SELECT a.o_orderpriority, a.day, any_value(a.total) AS total, count(b.total) AS n, median(b.total) AS med, list(b.total) AS xs FROM d a LEFT JOIN d b ON a.o_orderpriority = b.o_orderpriority AND b.day BETWEEN a.day - 30 AND a.day - 1 GROUP BY ALL),
z AS (SELECT o_orderpriority, day, CASE WHEN n >= 10 THEN abs(total - med) / greatest(1.4826::DOUBLE * list_median(list_transform(xs, lambda x: abs(x - med))), 1e-9) END AS z FROM m)
SELECT o_orderpriority, CAST(day AS VARCHAR) AS day, round(z, 6) AS z, coalesce(z >= 2.5, false) AS is_anomaly FROM z""",
    "a33_weekly_mean": _H + ", d AS (SELECT user_id, day, avg(skip::INT) AS r, count(*) AS plays FROM h GROUP BY ALL) SELECT user_id, CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week, round(sum(r * plays) / sum(plays), 9) AS skip_rate, CAST(sum(plays) AS BIGINT) AS plays FROM d GROUP BY ALL",
    "a27_media_mix": _H + " SELECT user_id, round(avg((media_type = 'music')::INT), 9) AS music_share, round(avg((media_type = 'podcast')::INT), 9) AS podcast_share, round(avg((media_type = 'other')::INT), 9) AS other_share, round(coalesce(sum(ms) FILTER (media_type = 'music'), 0)::DOUBLE / nullif(sum(ms), 0), 9) AS music_time_share FROM h GROUP BY user_id",
    "a32_fractional_shares": f"WITH {_C}"
    + """, l AS (SELECT DISTINCT opportunity_id, unnest(""" + LISTED_SQL.format("dominant_release_labels") + """) AS label FROM c),
k AS (SELECT opportunity_id, label, 1.0::DOUBLE / count(*) OVER (PARTITION BY opportunity_id) AS w FROM l WHERE label <> '')
SELECT label, round(sum(w), 6) AS events, round(sum(w * days_since_latest_release), 3) AS days_since_latest_release FROM k JOIN c USING (opportunity_id) GROUP BY label""",
    "a36_min_max": """SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 9) AS norm,
  round(coalesce(1 - (s_acctbal - min(s_acctbal) OVER w) / nullif(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 0), 0.5), 9) AS nation_norm FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""",
    "a45_quality": """
WITH q AS (SELECT count(*) AS n, count(*) FILTER (trim(coalesce(artist_name, '')) = '') AS a, count(*) FILTER (ts IS NULL) AS t, count(*) FILTER (ms_played IS NULL OR ms_played < 0 OR ms_played > 86400000) AS m,
  count(*) FILTER (skipped IS NOT NULL AND lower(trim(skipped)) NOT IN ('true', '1', 'yes', 'y', 'false', '0', 'no', 'n')) AS s FROM streaming_history)
SELECT 'rows' AS "check", n AS bad, 0.0::DOUBLE AS share, n > 0 AS passed FROM q UNION ALL SELECT 'artist_name', a, round(a::DOUBLE / n, 9), a::DOUBLE / n <= 0.5 FROM q UNION ALL SELECT 'ts', t, round(t::DOUBLE / n, 9), t::DOUBLE / n <= 0.5 FROM q
UNION ALL SELECT 'ms_played', m, round(m::DOUBLE / n, 9), m::DOUBLE / n <= 0.5 FROM q UNION ALL SELECT 'skipped', s, round(s::DOUBLE / n, 9), s::DOUBLE / n <= 0.5 FROM q UNION ALL SELECT 'shuffle', 0, 0, true FROM q UNION ALL SELECT 'offline', 0, 0, true FROM q""",
    "a49_regime_shifts": _H
    + """, m AS (SELECT strftime(ts, '%Y-%m') AS month, platform, count(*) AS n FROM h WHERE platform IS NOT NULL GROUP BY ALL), s AS (SELECT month, platform, n::DOUBLE / sum(n) OVER (PARTITION BY month) AS s FROM m),
g AS (SELECT month, lag(month) OVER (ORDER BY month) AS before FROM (SELECT DISTINCT month FROM m)), c AS (SELECT g.month, p.platform, round(coalesce(a.s, 0) - coalesce(b.s, 0), 9) AS d FROM g CROSS JOIN (SELECT DISTINCT platform FROM m) p
  LEFT JOIN s a ON a.month = g.month AND a.platform = p.platform LEFT JOIN s b ON b.month = g.before AND b.platform = p.platform WHERE g.before IS NOT NULL AND (a.s IS NOT NULL OR b.s IS NOT NULL))
SELECT month, round(0.5 * sum(abs(d)), 10) AS shift, arg_min(platform, (-d, platform)) AS gain, arg_min(platform, (d, platform)) AS loss FROM c GROUP BY month""",
    "a50_mean_spread": "SELECT c_mktsegment, c_nationkey, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(coalesce(stddev_samp(c_acctbal), 0), 6) AS std, round(1.96 * coalesce(stddev_samp(c_acctbal), 0) / sqrt(count(c_acctbal)), 6) AS ci95 FROM customer GROUP BY ALL",
    "w20_rank_present": f"WITH {_C}, s AS (SELECT *, CASE WHEN isnan(opportunity_score) THEN NULL ELSE opportunity_score END AS v FROM c) SELECT opportunity_id, CASE WHEN v IS NOT NULL THEN dense_rank() OVER (PARTITION BY report_family_id ORDER BY v DESC NULLS LAST) ELSE 0 END AS place FROM s",
    "w21_top_one": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "w28_w29_transitions": _H
    + """, s AS (SELECT lag(artist) OVER (PARTITION BY user_id ORDER BY us, event_id) AS source, artist AS target FROM h WHERE artist <> ''), n AS (SELECT source, target, count(*) AS n FROM s WHERE source IS NOT NULL AND source <> target GROUP BY ALL),
x AS (SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY source), 9) AS out_share, round(n::DOUBLE / sum(n) OVER (PARTITION BY target), 9) AS in_share FROM n) SELECT * FROM x WHERE n >= 2""",
    "w28_w29_session_transitions": _X + "SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY source), 9) AS out_share, round(n::DOUBLE / sum(n) OVER (PARTITION BY target), 9) AS in_share FROM (SELECT source, target, n FROM e WHERE source <> target)",
    "w30_artist_profile": _X
    + """, o AS (SELECT source, sum(n) AS n, count(*) AS t, sum((n + 1) * ln(n + 1)) AS l FROM e GROUP BY 1), i AS (SELECT target, sum(n) AS n FROM e GROUP BY 1), v AS (SELECT count(*) AS v FROM a)
SELECT a.artist, CAST(coalesce(o.n, 0) AS BIGINT) AS "out", CAST(coalesce(i.n, 0) AS BIGINT) AS "in", coalesce(o.t, 0) AS targets, round(CASE WHEN o.n IS NULL THEN ln(v) ELSE ln(o.n + v) - o.l / (o.n + v) END, 9) AS entropy FROM a LEFT JOIN o ON o.source = a.artist LEFT JOIN i ON i.target = a.artist, v""",
    "w30_node_profile": _H
    + """, s AS (SELECT lag(platform) OVER (PARTITION BY user_id ORDER BY us, event_id) AS source, platform AS target FROM h WHERE platform IS NOT NULL), n AS (SELECT source, target, count(*) AS n FROM s WHERE source IS NOT NULL GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS "out", count(*) AS targets, round(ln(sum(n) + 12) - sum((n + 1) * ln(n + 1)) / (sum(n) + 12), 9) AS entropy FROM n GROUP BY source""",
    "w36_snapshot_deltas": """
WITH l AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, CAST(day AS VARCHAR) AS day, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY day), 4) AS delta FROM l""",
}

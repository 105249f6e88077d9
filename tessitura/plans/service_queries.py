"""The daily comparison of a listener's artists, tracks and podcasts with the public lists, and reads of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.similarity import rank_weighted_jaccard, ranked_entities
from tessitura.plans.history import SQL, history
from tessitura.plans.service import ListeningQuery, ListeningService, narratives
from tessitura.tables import table

EDITION = 2024
QUERY = ListeningQuery(start="2024-06-01", dimension="artists", least_events=5)


def daily_comparison(spark: SparkSession, folder: str, edition: int = EDITION) -> DataFrame:
    """Per day and dimension: plays, minutes, different entities, similarity with both lists, their difference and the closer one."""
    clean = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]", "")
    h = history(spark, folder, "day", "media_type", "artist", "track", "episode_show_name", "ms").withColumn("show", clean("episode_show_name"))
    public = table(spark, folder, "public_listening_row").where(F.col("edition") == edition).withColumn("key", clean("name")).where("key <> ''")
    parts = []
    for dimension, column, medium, by in (("artists", "artist", "music", "n"), ("tracks", "track", "music", "n"), ("podcasts", "show", "podcast", "ms")):
        mine = ranked_entities(h.where((F.col("media_type") == medium) & (F.col(column) != "")).withColumnRenamed(column, "key"), ["day"], "key", "ms", by)
        part = mine.groupBy("day").agg(F.sum("n").alias("event_count"), F.round(F.sum("ms") / 60_000, 6).alias("duration_minutes"), F.count(F.lit(1)).alias("unique_entity_count"))
        for scope in ("global", "united_states"):
            ranks = public.where((F.col("dimension") == dimension) & (F.col("list_scope") == scope)).groupBy("key").agg(F.min("list_rank").alias("rank"))
            part = part.join(rank_weighted_jaccard(mine, ranks, ["day"], "key").select("day", F.col("similarity").alias(f"{scope}_similarity")), "day")
        parts.append(part.withColumn("dimension", F.lit(dimension)))
    g, u = F.col("global_similarity"), F.col("united_states_similarity")
    return reduce(DataFrame.unionByName, parts).select(
        F.col("day").cast("string").alias("listening_date"), "dimension", "event_count", "duration_minutes", "unique_entity_count", "global_similarity", "united_states_similarity",
        F.round(u - g, 9).alias("united_states_minus_global"), F.when(g > u, "global").when(u > g, "united_states").otherwise("tie").alias("closer_scope"), F.lit(str(edition)).alias("reference_alignment"),
    )


def _service(spark: SparkSession, folder: str) -> ListeningService:
    return ListeningService(spark, frame=daily_comparison(spark, folder))


def a28_daily_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return daily_comparison(spark, folder)


def a21_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _service(spark, folder).summary(QUERY)


def a22_values(spark: SparkSession, folder: str) -> DataFrame:
    return _service(spark, folder).values("closer_scope")


def t5_daily_trend(spark: SparkSession, folder: str) -> DataFrame:
    return _service(spark, folder).daily_trend(QUERY).select(F.col("listening_date").cast("string").alias("listening_date"), "event_count", "global_similarity")


def a34_narratives(spark: SparkSession, folder: str) -> DataFrame:
    return narratives(daily_comparison(spark, folder))


def a21_summary_of_all(spark: SparkSession, folder: str) -> DataFrame:
    return _service(spark, folder).summary()


def a22_date_range(spark: SparkSession, folder: str) -> DataFrame:
    return _service(spark, folder).date_range().select(*(F.col(c).cast("string").alias(c) for c in ("first", "last")))


def t5_trend_of_all(spark: SparkSession, folder: str) -> DataFrame:
    return _service(spark, folder).daily_trend().select(F.col("listening_date").cast("string").alias("listening_date"), "dimension", "event_count", "closer_scope")


QUERIES = {f.__name__: f for f in (a28_daily_comparison, a21_summary, a21_summary_of_all, a22_values, a22_date_range, t5_daily_trend, t5_trend_of_all, a34_narratives)}

_K = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_D = (
    f"WITH {SQL.replace('episode_uri,', 'episode_uri, episode_show_name,')}"
    + f""", k AS (SELECT day, 'artists' AS dimension, artist AS key, ms FROM h WHERE media_type = 'music' UNION ALL SELECT day, 'tracks', track, ms FROM h WHERE media_type = 'music' UNION ALL SELECT day, 'podcasts', {_K.format('episode_show_name')}, ms FROM h WHERE media_type = 'podcast'),
t AS (SELECT day, dimension, key, count(*) AS n, sum(ms) AS ms FROM k WHERE key <> '' GROUP BY ALL),
r AS (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY day, dimension ORDER BY CASE WHEN dimension = 'podcasts' THEN ms ELSE n END DESC, CASE WHEN dimension = 'podcasts' THEN n ELSE ms END DESC, key) AS w FROM t),
p AS (SELECT list_scope AS scope, dimension, {_K.format('name')} AS key, 1.0::DOUBLE / min(list_rank) AS w FROM public_listening_row WHERE edition = {EDITION} GROUP BY ALL HAVING {_K.format('name')} <> ''),
b AS (SELECT r.day, r.dimension, p.scope, sum(least(r.w, p.w)) AS m FROM r JOIN p USING (dimension, key) GROUP BY ALL), a AS (SELECT scope, dimension, sum(w) AS w FROM p GROUP BY ALL),
g AS (SELECT day, dimension, CAST(sum(n) AS BIGINT) AS event_count, round(sum(ms) / 60000.0::DOUBLE, 6) AS duration_minutes, count(*) AS unique_entity_count, sum(w) AS w FROM r GROUP BY ALL),
s AS (SELECT g.day, g.dimension, a.scope, round(coalesce(m, 0) / (g.w + a.w - coalesce(m, 0)), 9) AS s FROM g JOIN a USING (dimension) LEFT JOIN b ON b.day = g.day AND b.dimension = g.dimension AND b.scope = a.scope),
d AS (SELECT CAST(g.day AS VARCHAR) AS listening_date, g.dimension, event_count, duration_minutes, unique_entity_count, x.s AS global_similarity, y.s AS united_states_similarity, round(y.s - x.s, 9) AS united_states_minus_global,
  CASE WHEN x.s > y.s THEN 'global' WHEN y.s > x.s THEN 'united_states' ELSE 'tie' END AS closer_scope, '{EDITION}' AS reference_alignment
  FROM g JOIN s x ON x.day = g.day AND x.dimension = g.dimension AND x.scope = 'global' JOIN s y ON y.day = g.day AND y.dimension = g.dimension AND y.scope = 'united_states')
"""
)
_W = "WHERE listening_date >= '2024-06-01' AND dimension = 'artists' AND event_count >= 5"
ORACLE = {
    "a28_daily_comparison": _D + "SELECT * FROM d",
    "a21_summary": _D
    + f"""SELECT count(DISTINCT listening_date) AS days, CAST(coalesce(sum(event_count), 0) AS BIGINT) AS events, round(coalesce(sum(duration_minutes), 0), 6) AS minutes, round(coalesce(avg(global_similarity), 0), 9) AS mean_global,
  round(coalesce(avg(united_states_similarity), 0), 9) AS mean_united_states, round(max(greatest(global_similarity, united_states_similarity)), 9) AS best, count(*) FILTER (closer_scope = 'global') AS closer_global FROM d {_W}""",
    "a21_summary_of_all": _D
    + """SELECT count(DISTINCT listening_date) AS days, CAST(coalesce(sum(event_count), 0) AS BIGINT) AS events, round(coalesce(sum(duration_minutes), 0), 6) AS minutes, round(coalesce(avg(global_similarity), 0), 9) AS mean_global,
  round(coalesce(avg(united_states_similarity), 0), 9) AS mean_united_states, round(max(greatest(global_similarity, united_states_similarity)), 9) AS best, count(*) FILTER (closer_scope = 'global') AS closer_global FROM d""",
    "a22_date_range": _D + "SELECT min(listening_date) AS first, max(listening_date) AS last FROM d",
    "t5_trend_of_all": _D + "SELECT listening_date, dimension, event_count, closer_scope FROM d",
    "a22_values": _D + "SELECT DISTINCT closer_scope FROM d",
    "t5_daily_trend": _D + f"SELECT listening_date, event_count, global_similarity FROM d {_W}",
    "a34_narratives": _D
    + """, x AS (SELECT listening_date, dimension, 'global' AS scope, global_similarity AS v FROM d UNION ALL SELECT listening_date, dimension, 'united_states', united_states_similarity FROM d), m AS (SELECT listening_date, max(v) AS best FROM x GROUP BY 1),
e AS (SELECT listening_date, CAST(sum(event_count) AS BIGINT) AS events FROM d GROUP BY 1)
SELECT listening_date, any_value(best) AS similarity, array_to_string(list_sort(list(DISTINCT scope)), '|') AS scopes, array_to_string(list_sort(list(DISTINCT dimension)), '|') AS dimensions, any_value(events) AS events,
  'Closest to ' || array_to_string(list_sort(list(DISTINCT scope)), ' and ') || ' in ' || array_to_string(list_sort(list(DISTINCT dimension)), ', ') || ' (' || format('{:.2f}', round(any_value(best), 2)) || ') over ' || any_value(events) || ' plays' AS headline,
  CASE WHEN any_value(events) < 10 THEN 'few plays' WHEN count(DISTINCT scope) > 1 THEN 'both lists are equally close' ELSE '' END AS caveat
FROM x JOIN m USING (listening_date) JOIN e USING (listening_date) WHERE best - v <= 1e-12 GROUP BY listening_date""",
}

"""Queries of the comparisons with public lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.scalars import genre_label, name_key, name_key_sql
from tessitura.operators import compare
from tessitura.plans.history import SQL, history
from tessitura.plans.relation_queries import recent_days
from tessitura.tables import table

EDITION, MOST, SCOPES, WINDOW = 2024, 10, ("global", "united_states"), ("2024-01-01", "2024-11-15")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    h = history(spark, folder, "day", "media_type", "artist", "track", "artist_name", "master_metadata_track_name", "episode_show_name", "ms")
    return h.withColumns({"track_name": F.col("master_metadata_track_name"), "show_name": F.col("episode_show_name"), "show": F.coalesce(name_key(F.col("episode_show_name")), F.lit(""))})


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return compare.entities(_events(spark, folder))


def _public(spark: SparkSession, folder: str) -> DataFrame:
    return compare.public_ranks(table(spark, folder, "public_listening_row"), EDITION, MOST)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(compare.daily_comparison(_entities(spark, folder), _public(spark, folder), SCOPES, edition=EDITION, window=WINDOW, most=MOST))


def a28_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(spark, folder)


def a29_mart(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(compare.daily_similarity_mart(_daily(spark, folder)))


def _overall(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(compare.comparison(compare.ranked(_entities(spark, folder), []), _public(spark, folder), SCOPES, [], MOST))


def a24_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    return _overall(spark, folder).drop("personal_top_entity", "personal_top_entity_detail", "personal_top_entity_public_rank")


def a24_months(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(compare.monthly_alignment(_entities(spark, folder), _public(spark, folder), SCOPES))


def a26_scopes(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(compare.scope_summary(_overall(spark, folder)))


def a30_lookback(spark: SparkSession, folder: str) -> DataFrame:
    """The last 90 days against the first 50 artists of the global list."""
    h = history(spark, folder, "day", "artist", "artist_name").where("artist <> ''")
    lists = table(spark, folder, "public_listening_row").where(f"dimension = 'artists' and list_scope = 'global' and edition = {EDITION} and list_rank <= 50")
    public = lists.withColumn("key", name_key(F.col("name"))).where("key <> ''").groupBy("key").agg(F.min("list_rank").alias("rank"), F.min("name").alias("name"))
    return compare.lookback_comparison(recent_days(h, h, 90), public, 25)


def a31_genres(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of scenes, as genres, in the music heard; an artist has the scenes of its opportunities as tags."""
    music = history(spark, folder, "media_type", "artist", "ms").where("media_type = 'music' and artist <> ''").select("artist", "ms")
    tags = table(spark, folder, "creator_ranking_opportunities").select(name_key(F.col("artist_name")).alias("artist"), genre_label(F.col("scene_name")).alias("tag")).where("artist <> '' and tag is not null").distinct()
    genres = tags.select(F.element_at(F.split("tag", " "), -1).alias("genre"), "tag").distinct()
    return _rounded(compare.genre_share(music, tags, genres))


def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Events of music and podcasts in a half-open span of days, by month: their number and minutes, and the first and last time of the whole history."""
    h = history(spark, folder, "day", "ts", "media_type", "ms")
    span = h.agg(F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))
    rows = h.where("day >= date'2024-02-01' and day < date_add(date'2024-11-15', 1) and media_type in ('music', 'podcast')")
    return _rounded(rows.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "media_type").agg(F.count(F.lit(1)).alias("events"), (F.sum("ms") / 60_000).alias("minutes")).join(F.broadcast(span)))


QUERIES = {f.__name__: f for f in (a24_dimensions, a24_months, a26_scopes, a28_grid, a29_mart, a30_lookback, a31_genres)} | {"scalars_coverage": p2_coverage}

_K = name_key_sql
_D = (
    f"WITH {SQL.replace('episode_uri,', 'episode_uri, episode_show_name, master_metadata_track_name,')}"
    + f""", w AS (SELECT episode_show_name, {_K("episode_show_name")} AS show_key FROM (SELECT DISTINCT episode_show_name FROM h)),
e AS (SELECT day, ms, 'artists' AS dimension, artist AS key, artist_name AS name, '' AS detail FROM h WHERE media_type = 'music' AND artist <> '' UNION ALL SELECT day, ms, 'tracks', track || '::' || artist, master_metadata_track_name, artist_name FROM h WHERE media_type = 'music' AND artist <> '' AND track <> ''
  UNION ALL SELECT day, ms, 'podcasts', show_key, h.episode_show_name, '' FROM h JOIN w ON h.episode_show_name = w.episode_show_name WHERE media_type = 'podcast' AND show_key <> ''),
l AS (SELECT list_scope AS scope, dimension, list_rank, {_K("name")} AS k, artists FROM public_listening_row WHERE edition = {EDITION} AND list_rank <= {MOST}),
pk AS (SELECT scope, dimension, list_rank, k AS key FROM l WHERE dimension <> 'tracks' UNION ALL SELECT scope, dimension, list_rank, k || '::' || {_K("a")} FROM (SELECT scope, dimension, list_rank, k, unnest(artists) AS a FROM l WHERE dimension = 'tracks')),
p AS (SELECT scope, dimension, key, min(list_rank) AS rank FROM pk WHERE key <> '' AND key NOT LIKE '::%' AND key NOT LIKE '%::' GROUP BY ALL),
pw AS (SELECT scope, dimension, sum(1.0::DOUBLE / rank) AS listed, count(*) AS public_count FROM (SELECT DISTINCT scope, dimension, rank FROM p) GROUP BY ALL),
sd AS (SELECT s AS scope FROM (VALUES ('global'), ('united_states')) v(s))
"""
)


def _compared(group: str) -> str:
    g = f"{group}, " if group else ""
    return f""", m AS (SELECT {g}dimension, key, count(*) AS n, sum(ms) AS ms, min(name) AS name, min(detail) AS detail FROM e GROUP BY {g}dimension, key),
r AS (SELECT *, row_number() OVER (PARTITION BY {g}dimension ORDER BY CASE WHEN dimension = 'podcasts' THEN ms ELSE n END DESC, CASE WHEN dimension = 'podcasts' THEN n ELSE ms END DESC, key) AS place FROM m),
x AS (SELECT r.*, sd.scope, p.rank AS pr FROM r CROSS JOIN sd LEFT JOIN p ON p.scope = sd.scope AND p.dimension = r.dimension AND p.key = r.key),
g AS (SELECT {g}scope, dimension, CAST(sum(n) AS BIGINT) AS event_count, sum(ms) AS ms, count(*) AS unique_entity_count, count(pr) AS shared_public_entity_count, count(pr) FILTER (place <= {MOST}) AS shared_top_count, count(*) FILTER (place <= {MOST}) AS personal_top_count, coalesce(sum(n) FILTER (pr IS NOT NULL), 0) AS hn, coalesce(sum(ms) FILTER (pr IS NOT NULL), 0) AS hms,
  max(name) FILTER (place = 1) AS personal_top_entity, max(detail) FILTER (place = 1) AS personal_top_entity_detail, CAST(max(pr) FILTER (place = 1) AS BIGINT) AS personal_top_entity_public_rank FROM x GROUP BY {g}scope, dimension),
k AS (SELECT {g}scope, dimension, pr, max(place) AS place FROM x WHERE place <= {MOST} AND pr IS NOT NULL GROUP BY {g}scope, dimension, pr UNION ALL SELECT {g}scope, dimension, NULL, place FROM x WHERE place <= {MOST} AND pr IS NULL),
j AS (SELECT {g}scope, dimension, sum(1.0::DOUBLE / place) AS own, coalesce(sum(least(1.0::DOUBLE / place, 1.0::DOUBLE / pr)) FILTER (pr IS NOT NULL), 0) AS both_ FROM k GROUP BY {g}scope, dimension),
q AS (SELECT {", ".join(f"g.{c}" for c in [*([group] if group else []), "scope", "dimension"])}, event_count, unique_entity_count, shared_public_entity_count, shared_top_count, personal_top_count, personal_top_entity, personal_top_entity_detail, personal_top_entity_public_rank, public_count, round(ms / 60000.0::DOUBLE, 9) AS duration_minutes, round(hn / event_count::DOUBLE, 9) AS event_share_on_public_top, round(coalesce(hms / nullif(ms, 0)::DOUBLE, 0), 9) AS duration_share_on_public_top,
  round(coalesce(both_ / nullif(own + coalesce(listed, 0) - both_, 0), 0), 9) AS rank_weighted_jaccard_similarity FROM g JOIN j ON {" AND ".join(f"j.{c} = g.{c}" for c in [*([group] if group else []), "scope", "dimension"])} LEFT JOIN pw ON pw.scope = g.scope AND pw.dimension = g.dimension)
"""


_LABEL = "CASE WHEN {0} >= 0.5 THEN 'strong' WHEN {0} >= 0.25 THEN 'moderate' WHEN {0} >= 0.1 THEN 'light' ELSE 'distinct' END"
_GRID = (
    _D
    + _compared("day")
    + f""", y AS (SELECT day, scope, dimension FROM (SELECT DISTINCT day FROM e), sd, (VALUES ('artists'), ('tracks'), ('podcasts')) v(dimension)),
d AS (SELECT CAST(y.day AS VARCHAR) AS listening_date, {EDITION} AS reference_edition, y.scope AS reference_scope, CASE WHEN y.scope = 'united_states' THEN 'US' END AS reference_country, CASE WHEN y.day < date '{WINDOW[0]}' THEN 'historical_projection' WHEN y.day > date '{WINDOW[1]}' THEN 'post_window_projection' ELSE 'date_aligned' END AS reference_alignment, y.dimension,
  CASE WHEN y.dimension = 'podcasts' THEN 'duration' ELSE 'events' END AS ranking_basis, coalesce(event_count, 0) AS event_count, coalesce(unique_entity_count, 0) AS unique_entity_count, coalesce(shared_public_entity_count, 0) AS shared_public_entity_count, coalesce(duration_minutes, 0) AS duration_minutes, coalesce(event_share_on_public_top, 0) AS event_share_on_public_top,
  coalesce(duration_share_on_public_top, 0) AS duration_share_on_public_top, coalesce(rank_weighted_jaccard_similarity, 0) AS rank_weighted_jaccard_similarity, CASE WHEN event_count > 0 THEN {_LABEL.format("rank_weighted_jaccard_similarity")} ELSE 'no personal data' END AS similarity_label, personal_top_entity, personal_top_entity_detail, personal_top_entity_public_rank,
  'public_listening_row/{EDITION}/' || y.scope AS public_source_url FROM y LEFT JOIN q ON q.day = y.day AND q.scope = y.scope AND q.dimension = y.dimension)
"""
)
_PAIR = ", ".join(f"max({c}) FILTER (reference_scope = '{s}') AS {s}_{n}" for n, c in (("similarity", "rank_weighted_jaccard_similarity"), ("event_share_on_public_top", "event_share_on_public_top"), ("duration_share_on_public_top", "duration_share_on_public_top")) for s in SCOPES)

ORACLE = {
    "a24_dimensions": _D + _compared("") + "SELECT * EXCLUDE (personal_top_entity, personal_top_entity_detail, personal_top_entity_public_rank) FROM q",
    "a24_months": _D
    + """, m AS (SELECT strftime(day, '%Y-%m') AS month, dimension, key, count(*) AS n, sum(ms) AS ms FROM e GROUP BY ALL), x AS (SELECT m.*, sd.scope, p.rank FROM m CROSS JOIN sd LEFT JOIN p ON p.scope = sd.scope AND p.dimension = m.dimension AND p.key = m.key)
SELECT month, scope, dimension, CAST(sum(n) AS BIGINT) AS events, round(sum(ms) / 60000.0::DOUBLE, 9) AS duration_minutes, round(coalesce(sum(n) FILTER (rank IS NOT NULL), 0) / sum(n)::DOUBLE, 9) AS event_share_on_public_top, round(coalesce(coalesce(sum(ms) FILTER (rank IS NOT NULL), 0) / nullif(sum(ms), 0)::DOUBLE, 0), 9) AS duration_share_on_public_top FROM x GROUP BY month, scope, dimension""",
    "a26_scopes": _D
    + _compared("")
    + f""", s AS (SELECT scope, avg(rank_weighted_jaccard_similarity) AS v, count(*) AS dimensions FROM q GROUP BY scope)
SELECT scope, round(v, 9) AS overall_similarity, dimensions, {_LABEL.format("v")} AS overall_label, scope = (SELECT scope FROM s ORDER BY v DESC, scope LIMIT 1) AS closest FROM s""",
    "a28_grid": _GRID + "SELECT * FROM d",
    "a29_mart": _GRID
    + f""", z AS (SELECT listening_date, dimension, {", ".join(f"max({c}) FILTER (reference_scope = 'global') AS {c}" for c in ("reference_edition", "reference_alignment", "event_count", "duration_minutes", "unique_entity_count", "personal_top_entity", "personal_top_entity_detail"))}, {_PAIR} FROM d GROUP BY ALL)
SELECT *, round(united_states_similarity - global_similarity, 9) AS united_states_minus_global, CASE WHEN united_states_similarity = global_similarity THEN 'tie' WHEN united_states_similarity > global_similarity THEN 'united_states' ELSE 'global' END AS closer_scope FROM z""",
    "a30_lookback": f"WITH {SQL}"
    + f""", a AS (SELECT * FROM h WHERE artist <> ''), v AS (SELECT artist, count(*) AS plays, min(artist_name) AS name FROM a WHERE day > (SELECT max(day) FROM a) - 90 GROUP BY 1),
p AS (SELECT k AS key, min(list_rank) AS rank, min(name) AS name FROM (SELECT *, {_K("name")} AS k FROM public_listening_row WHERE dimension = 'artists' AND list_scope = 'global' AND edition = {EDITION} AND list_rank <= 50) WHERE k <> '' GROUP BY 1), t AS (SELECT * FROM v ORDER BY plays DESC, artist LIMIT 25)
SELECT CASE WHEN rank IS NOT NULL THEN 'shared' ELSE 'distinctive' END AS kind, t.name, artist AS key, plays, rank AS public_rank FROM t LEFT JOIN p ON p.key = artist UNION ALL SELECT 'new', name, key, 0, rank FROM p WHERE key NOT IN (SELECT artist FROM v)""",
    "a31_genres": f"WITH {SQL}"
    + f""", m AS (SELECT artist, count(*) AS n, sum(ms) AS ms FROM h WHERE media_type = 'music' AND artist <> '' GROUP BY 1), t AS (SELECT DISTINCT {_K("artist_name")} AS artist, nullif(trim(regexp_replace(lower(scene_name), '[^a-z0-9]+', ' ', 'g')), '') AS tag FROM creator_ranking_opportunities),
k AS (SELECT * FROM t WHERE artist <> '' AND tag IS NOT NULL), o AS (SELECT DISTINCT artist, string_split(tag, ' ')[-1] AS genre FROM k), g AS (SELECT genre, count(*) AS artists, sum(n) AS n, sum(ms) AS ms FROM m JOIN o USING (artist) GROUP BY 1),
w AS (SELECT sum(n) AS n, sum(ms) AS ms, sum(n) FILTER (artist IN (SELECT artist FROM k)) AS tn, sum(ms) FILTER (artist IN (SELECT artist FROM k)) AS tms FROM m)
SELECT a.genre, coalesce(artists, 0) AS artists, CAST(coalesce(g.n, 0) AS BIGINT) AS events, round(coalesce(g.ms, 0) / 60000.0::DOUBLE, 9) AS duration_minutes, round(coalesce(g.n, 0) / w.n::DOUBLE, 9) AS music_event_share, round(coalesce(g.ms, 0) / w.ms::DOUBLE, 9) AS music_duration_share, round(tn / w.n::DOUBLE, 9) AS tagged_event_share, round(tms / w.ms::DOUBLE, 9) AS tagged_duration_share
FROM (SELECT DISTINCT genre FROM o) a LEFT JOIN g USING (genre), w""",
    "scalars_coverage": f"WITH {SQL}"
    + """ SELECT strftime(day, '%Y-%m') AS month, media_type, count(*) AS events, round(sum(ms) / 60000.0::DOUBLE, 9) AS minutes, (SELECT min(us) FROM h) AS first_us, (SELECT max(us) FROM h) AS last_us FROM h WHERE day >= date '2024-02-01' AND day < date '2024-11-16' AND media_type IN ('music', 'podcast') GROUP BY ALL""",
}

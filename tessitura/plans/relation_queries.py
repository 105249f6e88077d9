"""Queries of joins, set operations, sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions import scalars
from tessitura.operators import graph, relations
from tessitura.operators.rolling import utc_day
from tessitura.plans.history import SQL, history
from tessitura.tables import table


def j1_j2_left_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the totals of their orders and the dense rank of these in their nation."""
    totals = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = table(spark, folder, "customer").join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    return relations.rank_present(c, ["c_nationkey"], "total", "place").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "total", F.coalesce("place", F.lit(0)).alias("place"))


def j3_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Both scopes of the public lists side by side."""
    p = table(spark, folder, "public_listening_row")
    side = lambda s: p.where(F.col("list_scope") == s).groupBy("edition", "dimension", "name").agg(F.min("list_rank").alias(s))
    return side("global").join(side("united_states"), ["edition", "dimension", "name"], "full_outer").fillna(0)


def j4_j18_calendar_spine(spark: SparkSession, folder: str) -> DataFrame:
    """Events per active day and type, with 0 where there is none."""
    e = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    spine = e.select("day").distinct().join(F.broadcast(e.select("event_type").distinct()))
    n = e.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return spine.join(n, ["day", "event_type"], "left").fillna(0, ["n", "value"]).withColumn("day", F.col("day").cast("string"))


def j5_role_playing(spark: SparkSession, folder: str) -> DataFrame:
    """Flows between nations: the nation table as source and as target."""
    nation = table(spark, folder, "nation")
    role = lambda r: nation.select(F.col("n_nationkey").alias(f"{r}_key"), F.col("n_name").alias(r))
    flows = table(spark, folder, "lineitem").join(table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("source_key")), F.col("l_suppkey") == F.col("s_suppkey"))
    flows = flows.join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("target_key")), F.col("o_custkey") == F.col("c_custkey"))
    n = flows.groupBy("source_key", "target_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return n.join(role("source"), "source_key").join(role("target"), "target_key").select("source", "target", "n", "quantity")


def _public_artists(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "public_listening_row").where("dimension = 'artists'")
    return p.withColumn("artist", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")).where("artist <> ''")


def j11_heard_public(spark: SparkSession, folder: str) -> DataFrame:
    """Events of artists that a public list holds."""
    return history(spark, folder, "artist").join(_public_artists(spark, folder), "artist", "left_semi").select("event_id")


def j12_never_heard(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the public lists that nobody has heard."""
    return _public_artists(spark, folder).join(history(spark, folder, "artist"), "artist", "left_anti").select("ref_id")


def j13_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """First and last public rank of each heard pair of track and artist; a listed track stands under each of its artists."""
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    p = table(spark, folder, "public_listening_row").where("dimension = 'tracks'").select("ref_id", "list_rank", clean(F.col("name")).alias("track"), F.explode("artists").alias("a")).withColumn("artist", clean(F.col("a")))
    ranks = p.groupBy("track", "artist").agg(F.min_by("list_rank", "ref_id").alias("first_rank"), F.max_by("list_rank", "ref_id").alias("last_rank"))
    heard = history(spark, folder, "track", "artist").where("track <> '' and artist <> ''").groupBy("track", "artist").agg(F.count(F.lit(1)).alias("n"))
    return heard.join(ranks, ["track", "artist"])


def j14_dominance(spark: SparkSession, folder: str) -> DataFrame:
    brands = table(spark, folder, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"), F.max("p_size").alias("size"))
    return relations.dominated(brands, "p_brand", ["n", "price"], ["size"])


def j14_front(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return relations.pareto_front(parts, "l_partkey", "quantity", "discount")


def j16_paired(spark: SparkSession, folder: str) -> DataFrame:
    per = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    found = relations.paired_differences(per, "user_id", "event_type", "v")
    return found.select("model_a", "model_b", "n", *(F.round(c, 6).alias(c) for c in ("mean_diff", "stderr", "z")))


def j17_first_match(spark: SparkSession, folder: str) -> DataFrame:
    """Plays of a candidate track by its URI, else by the artist of that name: here over distinct pairs of the history."""
    h = history(spark, folder, "track_uri", "track", "artist")
    exact = h.where("track_uri is not null").groupBy("track_uri").agg(F.count(F.lit(1)).alias("plays"))
    loose = h.groupBy("track", "artist").agg(F.count(F.lit(1)).alias("plays"))
    rows = h.groupBy("track", "artist").agg(F.min("track_uri").alias("track_uri"))
    return relations.first_match(rows, exact, loose, "track_uri", ["track", "artist"], "plays").select("track", "artist", "plays")


def recent_days(h: DataFrame, of: DataFrame, days: int) -> DataFrame:
    """Rows of h on the last `days` days of `of`. The last day comes from a scalar subquery, so the filter goes below what made h."""
    last = of.agg(F.max("day")).scalar()
    return h.where(F.col("day") > F.date_sub(last, days))


def t2_top_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Top artists of the last 90 days, under their most frequent spelling: both from the counts of each spelling."""
    h = history(spark, folder, "day", "artist", "artist_name").where("artist <> ''")
    days = table(spark, folder, "streaming_history").where("user_id is not null and ts is not null and artist_key <> ''").select(F.date_from_unix_date(utc_day("ts")).alias("day"))
    spelt = recent_days(h, days, 90).groupBy("artist", "artist_name").agg(F.count(F.lit(1)).alias("n"))
    name = F.min(F.when(F.col("artist_name").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("artist_name").alias("v"))))["v"]
    return spelt.groupBy("artist").agg(F.sum("n").alias("n"), name.alias("name")).orderBy(F.desc("n"), "artist").limit(20)


def t3_top_of_row(spark: SparkSession, folder: str) -> DataFrame:
    pairs = F.transform("embedding", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return table(spark, folder, "embeddings").select("vec_id", F.concat_ws(",", F.transform(F.slice(F.array_sort(pairs), 1, 3), lambda p: p["i"].cast("string"))).alias("top"))


def t4_t5_notable_days(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc_nulls_last("high"), F.desc("day")).limit(10).withColumn("day", F.col("day").cast("string"))


def t6_evenly_spaced(spark: SparkSession, folder: str) -> DataFrame:
    return relations.evenly_spaced(table(spark, folder, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 100).select("event_id")


def t7_hashed_sample(spark: SparkSession, folder: str) -> DataFrame:
    return relations.hashed_sample(table(spark, folder, "events").select("event_id"), "event_id", 100)


def t8_beam(spark: SparkSession, folder: str) -> DataFrame:
    edges = graph.transitions(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return graph.beam(edges, "view", 3, 5).select(F.concat_ws(">", "path").alias("path"), F.round("score", 9).alias("score"))


def t10_top_per_medium(spark: SparkSession, folder: str) -> DataFrame:
    n = history(spark, folder, "media_type", "artist_name").where("artist_name is not null").groupBy("media_type", "artist_name").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("media_type").orderBy(F.desc("n"), "artist_name")
    return n.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5")


def w11_global_order(spark: SparkSession, folder: str) -> DataFrame:
    """Row numbers over the whole stream of events."""
    return relations.in_order(table(spark, folder, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")], "row_idx").select("event_id", "row_idx")


def u1_u3_union_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers and customers in one table with what either lacks as null; first of each nation by name."""
    s = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    c = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return relations.top_one(relations.union_all(s, c).distinct(), ["nation"], F.col("name"))


def u4_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Jaccard overlap of the seed artists of consecutive opportunities of a family."""
    c = table(spark, folder, "creator_ranking_opportunities").dropDuplicates(["opportunity_id"]).where("report_family_id is not null")
    names = scalars.listed(F.col("connected_seed_artists"))
    c = c.select("report_family_id", "opportunity_id", F.array_distinct(names).alias("names"))
    before = F.lag("names").over(Window.partitionBy("report_family_id").orderBy("opportunity_id"))
    both, either = F.size(F.array_intersect("names", "before")), F.size(F.array_union("names", "before"))
    return c.withColumn("before", before).where("before is not null").select("opportunity_id", F.round(F.when(either > 0, both / either).otherwise(0.0), 9).alias("overlap"))


def u5_new_since(spark: SparkSession, folder: str) -> DataFrame:
    """Artists of the last 30 days that were not heard before."""
    first = history(spark, folder, "day", "artist").where("artist <> ''").groupBy("artist").agg(F.min("day").alias("day"))
    days = table(spark, folder, "streaming_history").where("user_id is not null and ts is not null and artist_key <> ''").select(F.date_from_unix_date(utc_day("ts")).alias("day"))
    return recent_days(first, days, 30).select("artist")


def u4_list_difference(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "public_listening_row").where("dimension = 'artists' and list_scope = 'global'")
    return relations.list_difference(p.where("edition = 2023"), p.where("edition = 2024"), "name")


def p_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised values of raw history rows: truth values, epochs, device families, contents, name keys."""
    raw = table(spark, folder, "streaming_history").dropDuplicates(["event_id"])
    return raw.select(
        "event_id", scalars.tri_state(F.col("skipped")).cast("string").alias("skipped"), scalars.truth(F.col("skipped")).cast("string").alias("strict"), F.coalesce(scalars.epoch_ms(F.col("offline_timestamp")), F.lit(-1)).alias("offline_ms"), scalars.device_family(F.col("platform")).alias("family"),
        scalars.content_type(episode=F.col("episode_uri"), track=F.col("track_uri")).alias("content"), scalars.text_or_null(F.col("conn_country")).alias("country"), scalars.name_key(F.col("artist_name")).alias("name_key"),
    )


def p24_release_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order days cut to a precision by priority, parsed again."""
    o = table(spark, folder, "orders")
    precision = F.when(F.col("o_orderpriority").startswith("1"), "year").when(F.col("o_orderpriority").startswith("2"), "month").otherwise("day")
    raw = F.when(F.col("o_orderkey") % 13 == 0, "soon").when(F.col("o_orderkey") % 17 == 0, F.date_format("o_orderdate", "yyyy-13-dd")).when(F.col("o_orderkey") % 19 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", scalars.release_date(raw, precision).cast("string").alias("released"))


QUERIES = {n: f for n, f in list(globals().items()) if n.split("_")[0] in {"j1", "j3", "j4", "j5", "j11", "j12", "j13", "j14", "j16", "j17", "t2", "t3", "t4", "t6", "t7", "t8", "t10", "w11", "u1", "u4", "u5", "p24"} or n == "p_scalars"}
QUERIES = {{"p_scalars": "scalars_normalised", "p24_release_dates": "scalars_release_dates"}.get(n, n): f for n, f in QUERIES.items()}

_H = f"WITH {SQL}"
_PA = "a AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS artist FROM public_listening_row WHERE dimension = 'artists' AND regexp_replace(lower(name), '[^a-z0-9]', '', 'g') <> '')"
_C = "c AS (SELECT * FROM creator_ranking_opportunities QUALIFY row_number() OVER (PARTITION BY opportunity_id) = 1)"

ORACLE = {
    "j1_j2_left_joins": """WITH t AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS n, total, CASE WHEN total IS NOT NULL THEN dense_rank() OVER (PARTITION BY c_nationkey ORDER BY total DESC NULLS LAST) ELSE 0 END AS place FROM customer LEFT JOIN t ON o_custkey = c_custkey""",
    "j3_full_outer": "SELECT edition, dimension, name, coalesce(min(list_rank) FILTER (list_scope = 'global'), 0) AS global, coalesce(min(list_rank) FILTER (list_scope = 'united_states'), 0) AS united_states FROM public_listening_row GROUP BY ALL",
    "j4_j18_calendar_spine": """WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events) SELECT CAST(d.day AS VARCHAR) AS day, t.event_type, count(e.event_id) AS n, round(coalesce(sum(e.value), 0), 2) AS value
FROM (SELECT DISTINCT day FROM e) d CROSS JOIN (SELECT DISTINCT event_type FROM e) t LEFT JOIN e ON e.day = d.day AND e.event_type = t.event_type GROUP BY ALL""",
    "j5_role_playing": """SELECT s.n_name AS source, t.n_name AS target, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation s ON s.n_nationkey = s_nationkey JOIN nation t ON t.n_nationkey = c_nationkey GROUP BY ALL""",
    "j11_heard_public": _H + f", {_PA} SELECT event_id FROM h WHERE artist IN (SELECT artist FROM a)",
    "j12_never_heard": _H + f", {_PA} SELECT ref_id FROM a WHERE artist NOT IN (SELECT artist FROM h)",
    "j13_lookup": _H
    + """, x AS (SELECT ref_id, list_rank, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS track, unnest(artists) AS a FROM public_listening_row WHERE dimension = 'tracks'),
r AS (SELECT track, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') AS artist, arg_min(list_rank, ref_id) AS first_rank, arg_max(list_rank, ref_id) AS last_rank FROM x GROUP BY ALL)
SELECT track, artist, count(*) AS n, any_value(first_rank) AS first_rank, any_value(last_rank) AS last_rank FROM h JOIN r USING (track, artist) WHERE track <> '' AND artist <> '' GROUP BY track, artist""",
    "j14_dominance": """WITH b AS (SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS price, max(p_size) AS size FROM part GROUP BY 1),
w AS (SELECT x.p_brand AS a, y.p_brand AS b FROM b x JOIN b y ON x.n >= y.n AND x.price >= y.price AND x.size <= y.size AND (x.n > y.n OR x.price > y.price OR x.size < y.size))
SELECT p_brand, (SELECT count(*) FROM w WHERE w.a = p_brand) AS dominates, (SELECT count(*) FROM w WHERE w.b = p_brand) AS dominated_by FROM b""",
    "j14_front": """WITH p AS (SELECT l_partkey, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.quantity >= p.quantity AND o.discount >= p.discount AND (o.quantity > p.quantity OR o.discount > p.discount))""",
    "j16_paired": """WITH p AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), d AS (SELECT a.event_type AS model_a, b.event_type AS model_b, a.v - b.v AS d FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type < b.event_type),
g AS (SELECT model_a, model_b, count(*) AS n, avg(d) AS m, coalesce(stddev_samp(d), 0) / sqrt(count(*)) AS e FROM d GROUP BY ALL)
SELECT model_a, model_b, n, round(m, 6) AS mean_diff, round(e, 6) AS stderr, round(CASE WHEN e > 0 THEN m / e WHEN m > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS z FROM g""",
    "j17_first_match": _H
    + """, u AS (SELECT track_uri, count(*) AS n FROM h WHERE track_uri IS NOT NULL GROUP BY 1), l AS (SELECT track, artist, count(*) AS n, min(track_uri) AS track_uri FROM h GROUP BY 1, 2)
SELECT track, artist, coalesce(u.n, l.n) AS plays FROM l LEFT JOIN u USING (track_uri)""",
    "t2_top_tracks": _H
    + """, r AS (SELECT * FROM h WHERE artist <> '' AND day > (SELECT max(day) FROM h WHERE artist <> '') - 90), t AS (SELECT artist, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, artist LIMIT 20),
m AS (SELECT artist, artist_name AS name FROM r WHERE artist_name IS NOT NULL GROUP BY artist, artist_name QUALIFY row_number() OVER (PARTITION BY artist ORDER BY count(*) DESC, artist_name) = 1) SELECT * FROM t LEFT JOIN m USING (artist)""",
    "t3_top_of_row": "SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(embedding, lambda x, i: {'x': -x, 'i': i - 1}))[1:3], lambda p: p.i), ',') AS top FROM embeddings",
    "t4_t5_notable_days": "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, max(o_totalprice) AS high, count(*) AS n FROM orders GROUP BY 1 ORDER BY high DESC NULLS LAST, day DESC LIMIT 10",
    "t6_evenly_spaced": """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id FROM r WHERE i IN (SELECT CAST(round_even(k * ((SELECT count(*) FROM events) - 1) / 99.0::DOUBLE, 0) AS BIGINT) FROM range(100) t(k))""",
    "t8_beam": """WITH s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source, event_type AS target FROM events), n AS (SELECT source, target, count(*) AS n FROM s WHERE source IS NOT NULL AND source <> target GROUP BY ALL),
e AS (SELECT source, target, round(n::DOUBLE / sum(n) OVER (PARTITION BY source), 9) AS p FROM n),
a AS (SELECT ['view', target] AS path, round(p, 12) AS score FROM e WHERE source = 'view' ORDER BY score DESC, path LIMIT 5),
b AS (SELECT list_append(path, target) AS path, round(score * p, 12) AS score FROM a JOIN e ON e.source = path[2] AND NOT list_contains(path, target) ORDER BY score DESC, path LIMIT 5),
c AS (SELECT list_append(path, target) AS path, round(score * p, 12) AS score FROM b JOIN e ON e.source = path[3] AND NOT list_contains(path, target) ORDER BY score DESC, path LIMIT 5)
SELECT array_to_string(path, '>') AS path, round(score, 9) AS score FROM c""",
    "t10_top_per_medium": _H + " SELECT media_type, artist_name, count(*) AS n, row_number() OVER (PARTITION BY media_type ORDER BY count(*) DESC, artist_name) AS place FROM h WHERE artist_name IS NOT NULL GROUP BY media_type, artist_name QUALIFY place <= 5",
    "w11_global_order": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events",
    "u1_u3_union_dedupe": """WITH u AS (SELECT s_name AS name, s_nationkey AS nation, s_acctbal AS balance, NULL AS segment FROM supplier UNION SELECT c_name, c_nationkey, NULL, c_mktsegment FROM customer) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY nation ORDER BY name) = 1""",
    "u4_overlap": f"WITH {_C}"
    + f""", l AS (SELECT report_family_id, opportunity_id, list_distinct({scalars.LISTED_SQL.format("connected_seed_artists")}) AS n FROM c WHERE report_family_id IS NOT NULL),
p AS (SELECT opportunity_id, n, lag(n) OVER (PARTITION BY report_family_id ORDER BY opportunity_id) AS b FROM l)
SELECT opportunity_id, round(CASE WHEN len(list_distinct(list_concat(n, b))) > 0 THEN len(list_intersect(n, b))::DOUBLE / len(list_distinct(list_concat(n, b))) ELSE 0 END, 9) AS overlap FROM p WHERE b IS NOT NULL""",
    "u5_new_since": _H + ", x AS (SELECT artist, day > (SELECT max(day) FROM h WHERE artist <> '') - 30 AS late FROM h WHERE artist <> '') SELECT DISTINCT artist FROM x WHERE late AND artist NOT IN (SELECT artist FROM x WHERE NOT late)",
    "u4_list_difference": """WITH p AS (SELECT DISTINCT edition, name FROM public_listening_row WHERE dimension = 'artists' AND list_scope = 'global')
SELECT name, 'added' AS change FROM p WHERE edition = 2024 AND name NOT IN (SELECT name FROM p WHERE edition = 2023) UNION ALL SELECT name, 'removed' FROM p WHERE edition = 2023 AND name NOT IN (SELECT name FROM p WHERE edition = 2024)""",
    "scalars_normalised": """WITH r AS (SELECT * FROM streaming_history QUALIFY row_number() OVER (PARTITION BY event_id) = 1)
SELECT event_id, CASE WHEN lower(trim(skipped)) IN ('true', '1', 'yes', 'y', 't') THEN 'true' WHEN lower(trim(skipped)) IN ('false', '0', 'no', 'n', 'f') THEN 'false' END AS skipped,
  CASE WHEN lower(trim(skipped)) IN ('true', '1', 'yes', 'y') THEN 'true' WHEN lower(trim(skipped)) IN ('false', '0', 'no', 'n') THEN 'false' END AS strict, coalesce(CASE WHEN abs(offline_timestamp) < 10000000000 THEN offline_timestamp * 1000 ELSE offline_timestamp END, -1) AS offline_ms,
  CASE WHEN regexp_matches(lower(coalesce(platform, '')), 'ios|iphone|ipad|android|mobile|phone|tablet') THEN 'mobile' WHEN regexp_matches(lower(coalesce(platform, '')), 'windows|mac|osx|linux|desktop|web') THEN 'desktop' ELSE 'other' END AS family,
  CASE WHEN trim(coalesce(episode_uri, '')) <> '' THEN 'episode' WHEN trim(coalesce(track_uri, '')) <> '' THEN 'track' ELSE 'unknown' END AS content, nullif(trim(conn_country), '') AS country,
  """
    + scalars.name_key_sql("artist_name")
    + " AS name_key FROM r",
    "scalars_release_dates": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 13 = 0 OR (o_orderkey % 17 = 0 AND o_orderpriority NOT LIKE '1%') OR (o_orderkey % 17 > 0 AND o_orderkey % 19 = 0) THEN NULL WHEN o_orderpriority LIKE '1%' THEN CAST(date_trunc('year', o_orderdate) AS DATE) WHEN o_orderpriority LIKE '2%' THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS released FROM orders",
}

"""Queries of metrics, retrieval and models. Class probabilities are the softmax of the first numbers of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators import graph, learning, media, metrics, retrieval, sequence
from tessitura.plans.history import SQL, history
from tessitura.plans.sequence_queries import STREAM, sessions
from tessitura.session import materialize
from tessitura.tables import table

CLASSES = 10


def _proba(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.pmod("label", F.lit(CLASSES)).alias("label"), F.slice("embedding", 1, CLASSES).alias("scores")).withColumn("proba", F.transform(metrics.softmax("scores"), lambda x: F.round(x, 12)))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.with_rank(_proba(spark, folder), "proba", "label")


def m1_m2_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ranking_metrics(_ranked(spark, folder), 3, "proba", CLASSES)


def m5_class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.class_weights(table(spark, folder, "lineitem"), "l_returnflag")


def m6_mean_differences(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.mean_differences(table(spark, folder, "lineitem"), "l_linestatus", "O", "F", ["l_quantity", "l_discount", "l_tax"])


def m7_share_shift(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.share_shift(table(spark, folder, "orders"), "o_orderstatus", "O", "F", "o_orderpriority")


def m8_js_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.js_divergence(table(spark, folder, "orders"), "o_orderstatus", "O", "F", "o_orderpriority")


def m9_js_distance(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.js_divergence(metrics.histogram_bins(table(spark, folder, "lineitem"), "l_extendedprice"), "l_linestatus", "O", "F", "bin")


def m11_calibration(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.calibration(_ranked(spark, folder))


def m11_brier(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.brier(_proba(spark, folder), "proba", "label")


def m13_temperature(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.temperature_search(_proba(spark, folder), "scores", "label", [0.5, 1.0, 2.0, 4.0])


def m14_conformal(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.conformal_threshold(_ranked(spark, folder), 0.1)


def m15_risk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.risk_coverage(_ranked(spark, folder), 20)


def m16_prediction_sets(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.prediction_sets(_ranked(spark, folder), "proba", 0.9)


def m36_recency(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.recency_weights(history(spark, folder, "ts"), "ts", 90, 0.25, 4).select("event_id", F.round("weight", 6).alias("weight"))


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")


def m18_popularity(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.popularity(_baskets(spark, folder), "l_orderkey", "l_partkey", 20)


def m18_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.item_neighbours(_baskets(spark, folder), "l_orderkey", "l_partkey", 3, 1.0)


def m18_autoencoder(spark: SparkSession, folder: str) -> DataFrame:
    """Over brands of parts as items of orders."""
    brands = _baskets(spark, folder).join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return retrieval.linear_autoencoder(brands, "l_orderkey", "p_brand").select("item", "neighbour", F.round("weight", 6).alias("weight"))


def m19_supported(spark: SparkSession, folder: str) -> DataFrame:
    h = history(spark, folder, "user_id", "artist").where("artist <> ''").select("user_id", "artist").distinct()
    return retrieval.supported(h, "user_id", "artist", 20, 10)


def m20_negatives(spark: SparkSession, folder: str) -> DataFrame:
    h = history(spark, folder, "user_id", "artist").where("artist <> ''").select("user_id", "artist").distinct()
    return retrieval.negative_samples(h, "user_id", "artist", h, 2)


def m20_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Per user: positives, their negatives, and how many of these are positives of the user."""
    h = materialize(history(spark, folder, "user_id", "artist").where("artist <> ''").select("user_id", "artist").distinct(), "positives")
    found = materialize(retrieval.negative_samples(h, "user_id", "artist", h, 2), "negatives")
    wrong = found.join(h.select("user_id", F.col("artist").alias("negative")), ["user_id", "negative"], "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("wrong"))
    per = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("negatives"))
    return h.groupBy("user_id").agg(F.count(F.lit(1)).alias("positives")).join(per, "user_id", "left").join(wrong, "user_id", "left").fillna(0)


def m21_m22_fusion_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of lists fused from two neighbour scores, against the first three of one of them: how much of it the fusion keeps, not how well it foretells."""
    near = retrieval.item_neighbours(_baskets(spark, folder), "l_orderkey", "l_partkey", 10, 1.0)
    plain = retrieval.item_neighbours(_baskets(spark, folder), "l_orderkey", "l_partkey", 10)
    fused = retrieval.reciprocal_fusion([near, plain], "item", "neighbour", "place", 10)
    return retrieval.recall_at(fused, near.where("place <= 3"), "item", "neighbour", "place", [1, 3, 10])


def m24_lsh(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of the candidates of every row divisible by 50, among all, from hash tables fitted to find nine of ten."""
    e = table(spark, folder, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    bits, tables, _ = retrieval.hash_index(e, "vec_id", "embedding", 64, asked, 5)
    codes = retrieval.sign_tables(e, "vec_id", "embedding", 64, bits, tables)
    found = retrieval.lsh_candidates(codes, "vec_id", codes.where("vec_id % 50 = 0"), bits)
    return retrieval.ranked_candidates(found, e, "vec_id", "embedding", asked, 5).where("place <= 5")


def m24_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the hash tables find nine of ten of the five nearest rows of every query."""
    near = t9_neighbours(spark, folder).select("query", F.col("neighbour").alias("candidate"))
    found = m24_lsh(spark, folder).where("place <= 5").select("query", "candidate", F.lit(1).alias("hit"))
    return near.join(found, ["query", "candidate"], "left").agg(F.count_distinct("query").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


def m27_session_votes(spark: SparkSession, folder: str) -> DataFrame:
    b = _baskets(spark, folder)
    return retrieval.session_votes(b, b.where("l_orderkey % 50 = 0"), "l_orderkey", "l_partkey", 5, 20)


def m29_space(spark: SparkSession, folder: str) -> DataFrame:
    return learning.vector_space(table(spark, folder, "embeddings"), "embedding", 8).select("vec_id", "space")


FEATURES = ["log_streams", "log_hours", "exploration_ratio", "skip_rate", "shuffle_rate", "offline_rate", "track_stream_share"]


def m30_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of days by seven features; 3 to 5 of them by the number of days."""
    h = history(spark, folder, "user_id", "day", "ms", "skip", "shuffle", "offline", "track_uri", "artist")
    days = media.day_features(h, ["user_id", "day"]).withColumns({"log_streams": F.log1p("total_streams"), "log_hours": F.log1p("engagement_hours")})
    days = materialize(days, "days")
    k = min(5, max(3, days.count() // 180))
    return learning.clusters(days, FEATURES, k).select("user_id", F.col("day").cast("string").alias("day"), "cluster", "total_streams", "engagement_hours", *FEATURES[2:], "repeat_intensity")


def m30_archetypes(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster's days, means and archetype, by the quartiles over the clusters."""
    found = m30_clusters(spark, folder)
    means = [c for c in found.columns if c not in ("user_id", "day", "cluster")]
    return media.archetypes(materialize(found.groupBy("cluster").agg(F.count(F.lit(1)).alias("days"), *(F.avg(c).alias(c) for c in means)), "clusters"))


def _friction(spark: SparkSession, folder: str) -> DataFrame:
    h = sequence.session_so_far(sequence.split_by_boundaries(sessions(spark, folder, "shuffle", "offline"), STREAM), STREAM)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    before = ["session_position", "session_skip_rate", "session_repeat_ratio"]
    rows = materialize(h.select("event_id", "split", number("skip"), F.hour("ts").cast("double").alias("hour"), *(number(c) for c in ("shuffle", "offline", *before))), "friction")
    return learning.with_and_without(rows.where("split = 'train'"), rows, ["hour", "shuffle", *before], {"offline": 0.0}, "skip")


def m33_friction(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of a skip by hour, shuffle and the session so far, with and without offline as friction, and with offline at 0; fitted on the training split."""
    return _friction(spark, folder).select("event_id", "split", "score", "baseline", "healthy", "delta")


def m33_friction_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Of each split: AUC without and with friction, mean chance of a skip, and the mean change with friction at its healthy value."""
    found = materialize(_friction(spark, folder), "friction-scores")
    rows = []
    for split in ("train", "validation", "test"):
        part = found.where(F.col("split") == split)
        rows.append((split, learning.auc(part, "baseline", "skip"), learning.auc(part, "score", "skip")))
    aucs = spark.createDataFrame(rows, "split string, baseline_auc double, auc double")
    means = found.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in ("score", "healthy", "delta")))
    return means.join(aucs, "split")


def m31_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of nations by their customers, as many as the root of their number."""
    c = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    return learning.scenes(c, ["mean", "n"]).select("c_nationkey", "cluster")


def m34_decomposition(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of a skip by preference (hour, shuffle, session so far) and by friction (offline, position in the session)."""
    h = sequence.session_so_far(sequence.split_by_boundaries(sessions(spark, folder, "shuffle", "offline"), STREAM), STREAM)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    rows = materialize(h.select("event_id", "split", *(number(c) for c in ("skip", "shuffle", "offline", "session_position", "session_skip_rate", "session_repeat_ratio"))), "decomposition")
    found = learning.skip_decomposition(rows.where("split = 'train'"), rows.where("split <> 'train'"), ["shuffle", "session_skip_rate", "session_repeat_ratio"], ["offline", "session_position"], "skip")
    return found.select("event_id", "split", "total_risk", "preference_risk", "friction_risk", "friction_uplift")


def t9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest vectors of every row whose id is divisible by 50, among all rows."""
    e = table(spark, folder, "embeddings")
    return graph.top_neighbours(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), 5)


QUERIES = {n: f for n, f in list(globals().items()) if n[:2] in ("m1", "m2", "m3", "m5", "m6", "m7", "m8", "m9", "t9")}

_E = f"WITH s AS (SELECT vec_id, label % {CLASSES} AS y, list_transform(embedding[1:{CLASSES}], lambda x: x::DOUBLE) AS z FROM embeddings), "


def _soft(t: float) -> str:
    return f"list_transform(z, lambda x: exp((x - list_max(z)) / {t}::DOUBLE) / list_sum(list_transform(z, lambda w: exp((w - list_max(z)) / {t}::DOUBLE))))"


_P = _E + f"p AS (SELECT vec_id, y, list_transform({_soft(1.0)}, lambda x: round(x, 12)) AS p FROM s), r AS (SELECT *, p[y + 1] AS own, list_max(p) AS top, 1 + len(list_filter(p, lambda x, i: x > p[y + 1] OR (x = p[y + 1] AND i - 1 < y))) AS rk FROM p) "
_JS = """, g AS (SELECT v, (count(*) FILTER (s = 'O'))::DOUBLE / sum(count(*) FILTER (s = 'O')) OVER () AS p, (count(*) FILTER (s = 'F'))::DOUBLE / sum(count(*) FILTER (s = 'F')) OVER () AS q FROM x WHERE s IN ('O', 'F') GROUP BY v),
j AS (SELECT greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0) AS js FROM g) SELECT round(js, 6) AS divergence, round(sqrt(js), 6) AS distance FROM j"""
_B = "WITH b AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS i FROM lineitem), n AS (SELECT i, count(*) AS n FROM b GROUP BY i), c AS (SELECT x.i, y.i AS j, count(*) AS c FROM b x JOIN b y ON x.s = y.s AND x.i <> y.i GROUP BY ALL)"
_NEAR = ", k{0} AS (SELECT c.i AS item, c.j AS neighbour, round(c / (sqrt(a.n::DOUBLE * b.n) + {1}), 9) AS score, row_number() OVER (PARTITION BY c.i ORDER BY round(c / (sqrt(a.n::DOUBLE * b.n) + {1}), 9) DESC, c.j) AS place FROM c JOIN n a ON a.i = c.i JOIN n b ON b.i = c.j QUALIFY place <= {2})"

ORACLE = {
    "m1_m2_ranking": _P
    + f""", c AS (SELECT unnest(list_transform(list_sort(list_transform(p, lambda x, i: {{'p': -x, 'i': i}})), lambda v: v.i)[1:3]) AS c FROM r), n AS (SELECT c, count(*) AS n FROM c GROUP BY c),
d AS (SELECT count(*)::DOUBLE / {CLASSES} AS coverage, 1 - sum(n * n)::DOUBLE / (sum(n) * sum(n)) AS diversity FROM n)
SELECT round(avg((rk <= 3)::INT), 9) AS hit, round(avg(CASE WHEN rk <= 3 THEN 1 / log2(rk + 1) ELSE 0 END), 9) AS ndcg, round(avg(CASE WHEN rk <= 3 THEN 1.0::DOUBLE / rk ELSE 0 END), 9) AS mrr, round(any_value(coverage), 9) AS coverage, round(any_value(diversity), 9) AS diversity FROM r, d""",
    "m5_class_weights": "SELECT l_returnflag, count(*) AS n, round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 9) AS weight FROM lineitem GROUP BY l_returnflag",
    "m6_mean_differences": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(coalesce((avg({c}) FILTER (l_linestatus = 'F') - avg({c}) FILTER (l_linestatus = 'O')) / nullif(sqrt((var_pop({c}) FILTER (l_linestatus = 'O') + var_pop({c}) FILTER (l_linestatus = 'F')) / 2), 0), 0), 9) AS smd FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")
    ),
    "m7_share_shift": """WITH g AS (SELECT o_orderpriority, (count(*) FILTER (o_orderstatus = 'O'))::DOUBLE / sum(count(*) FILTER (o_orderstatus = 'O')) OVER () AS a, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE / sum(count(*) FILTER (o_orderstatus = 'F')) OVER () AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, round(a, 9) AS share_a, round(b, 9) AS share_b, round(b - a, 9) AS shift FROM g""",
    "m8_js_divergence": "WITH x AS (SELECT o_orderpriority AS v, o_orderstatus AS s FROM orders)" + _JS,
    "m9_js_distance": "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), x AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20)) + 1, 20) AS v, l_linestatus AS s FROM lineitem, e)" + _JS,
    "m11_calibration": _P
    + ", g AS (SELECT CAST(least(floor(top * 15), 14) AS BIGINT) AS bin, count(*) AS n, avg((rk = 1)::INT) AS a, avg(top) AS c FROM r GROUP BY 1) SELECT bin, n, round(a, 9) AS accuracy, round(c, 9) AS confidence, round(n::DOUBLE / sum(n) OVER () * abs(a - c), 9) AS ece_part FROM g",
    "m11_brier": _P + "SELECT round(avg(list_sum(list_transform(p, lambda x, i: (x - CASE WHEN i - 1 = y THEN 1 ELSE 0 END) ** 2))), 9) AS brier FROM p",
    "m13_temperature": _E[:-2] + " " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS temperature, round(avg(-ln(greatest(({_soft(t)})[y + 1], 1e-12))), 9) AS nll FROM s" for t in (0.5, 1.0, 2.0, 4.0)),
    "m14_conformal": _P + ", o AS (SELECT 1 - own AS s, row_number() OVER (ORDER BY 1 - own) AS k, count(*) OVER () AS n FROM r) SELECT round(s, 9) AS threshold, n FROM o WHERE k = least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n)",
    "m15_risk_coverage": _P
    + ", g AS (SELECT CAST(least(floor(top * 20), 19) AS BIGINT) AS bin, count(*) AS n, sum((rk <> 1)::INT) AS e FROM r GROUP BY 1) SELECT bin, round(sum(n) OVER w::DOUBLE / sum(n) OVER (), 9) AS coverage, round(sum(e) OVER w::DOUBLE / sum(n) OVER w, 9) AS risk FROM g WINDOW w AS (ORDER BY bin DESC)",
    "m16_prediction_sets": _P + ", c AS (SELECT len(list_filter(p, lambda x: 1 - x <= 0.9::DOUBLE)) AS n, (1 - own <= 0.9::DOUBLE)::INT AS i FROM r) SELECT round(avg(i), 9) AS coverage, round(avg(n), 9) AS mean_size, round(avg((n = 1)::INT), 9) AS single, round(avg((n = 0)::INT), 9) AS empty FROM c",
    "m36_recency": f"WITH {SQL}, w AS (SELECT event_id, 2.0::DOUBLE ** (-((max(us) OVER () - us) / 86400000000.0::DOUBLE) / 90) AS r FROM h) SELECT event_id, round(least(greatest(r / avg(r) OVER (), 0.25), 4), 6) AS weight FROM w",
    "m18_popularity": "SELECT l_partkey, count(DISTINCT l_orderkey) AS n, row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, l_partkey) AS place FROM lineitem GROUP BY l_partkey QUALIFY place <= 20",
    "m18_neighbours": _B + _NEAR.format(1, 1, 3) + " SELECT item, neighbour, score, place FROM k1",
    "m21_m22_fusion_recall": _B
    + _NEAR.format(1, 1, 10)
    + _NEAR.format(2, 0, 10)
    + """, f AS (SELECT item, neighbour, round(sum(1.0::DOUBLE / (place + 60)), 12) AS s FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2) GROUP BY ALL), o AS (SELECT item, neighbour, row_number() OVER (PARTITION BY item ORDER BY s DESC, neighbour) AS place FROM f QUALIFY place <= 10),
h AS (SELECT k1.item, coalesce(o.place, 1000000) AS place FROM k1 LEFT JOIN o USING (item, neighbour) WHERE k1.place <= 3), q AS (SELECT item, k, avg((place <= k)::INT) AS r FROM h, (VALUES (1), (3), (10)) v(k) GROUP BY ALL)
SELECT CAST(k AS BIGINT) AS k, round(avg(r), 9) AS recall FROM q GROUP BY k""",
    "m20_completeness": f"WITH {SQL}, p AS (SELECT DISTINCT user_id, artist FROM h WHERE artist <> ''), n AS (SELECT count(DISTINCT artist) AS n FROM p) SELECT user_id, count(*) AS positives, CASE WHEN count(*) < any_value(n) THEN 2 * count(*) ELSE 0 END AS negatives, 0 AS wrong FROM p, n GROUP BY user_id",
    "m24_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "m27_session_votes": """WITH b AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS i FROM lineitem), q AS (SELECT * FROM b WHERE s % 50 = 0), z AS (SELECT s, count(*) AS n FROM b GROUP BY s),
c AS (SELECT q.s AS a, b.s AS b, count(*) AS c FROM q JOIN b USING (i) WHERE q.s <> b.s GROUP BY ALL), w AS (SELECT a, b, round(c / sqrt(x.n::DOUBLE * y.n), 9) AS w FROM c JOIN z x ON x.s = a JOIN z y ON y.s = b),
k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= 20), v AS (SELECT k.a, b.i, round(sum(w), 9) AS votes FROM k JOIN b ON b.s = k.b WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.s = k.a AND q.i = b.i) GROUP BY ALL)
SELECT a AS l_orderkey, i AS l_partkey, votes, row_number() OVER (PARTITION BY a ORDER BY votes DESC, i) AS place FROM v QUALIFY place <= 5""",
    "t9_neighbours": """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS place FROM p QUALIFY place <= 5""",
}

"""The queries of this subpackage over the tables of a data folder, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.cooccur import cooccurrence
from tessitura.llm.encode import count_tokens, encode
from tessitura.llm.lookalike import consistent_form, look_sql, same_look
from tessitura.llm.packing import pack
from tessitura.llm.residue import find_residue, train_residue_model
from tessitura.operators.gaptree import gap_sessions
from tessitura.tables import table

#: Chi-squared with one degree of freedom at 5 %.
SIGNIFICANT = 3.841458820694124
#: Tokens in a container of problem 7.
CONTAINER = 2_048


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """kind, items: candidates of each ranking query, track keys of each listening session.

    Rows that repeat a query_id are the same record; should their arrays differ, the basket holds the items of all.
    """
    ranked = table(spark, folder, "track_reranking_split").where("query_id is not null").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_set("candidate_track_uris"))).alias("items"))
    heard = gap_sessions(table(spark, folder, "streaming_history"), "user_id", "ts", "event_id", "track_name_key", with_keys=True)
    return ranked.select(F.lit("query").alias("kind"), "items").unionByName(heard.select(F.lit("session").alias("kind"), F.col("keys").alias("items")))


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence(baskets(spark, folder), min_count=5, min_ratio=5, min_llr=SIGNIFICANT)


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of tracks that share baskets significantly more often than by chance, with counts, ratio and log-likelihood ratio."""
    found = cooccurrence(baskets(spark, folder), min_count=5, min_ratio=1, min_llr=SIGNIFICANT)
    return found.select(F.col("kind").alias("basket"), "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("ratio", 6).alias("ratio"), F.round("llr", 4).alias("llr"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pairs(spark, folder).select(F.col("kind").alias("basket"), "item_a", "item_b")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "public_listening_row").where("dimension = 'artists'")
    return same_look(table(spark, folder, "streaming_history"), "event_id", "artist_name", listed, "ref_id", "name").select(F.col("id").alias("event_id"), F.col("ref").alias("ref_id"))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Each different event with the consistent form of its artist's name: a spelling of the public lists, or by table."""
    listed = table(spark, folder, "public_listening_row").where("dimension = 'artists'")
    events = table(spark, folder, "streaming_history").select("event_id", "artist_name").distinct()
    return consistent_form(events, "artist_name", listed, "name", "artist_form").select("event_id", "artist_form")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_bins(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, part, n_tokens, bin_id: documents in containers of 2,048 tokens."""
    bins = pack(count_tokens(table(spark, folder, "documents"), "doc_id", "text"), "id", "size", CONTAINER)
    return bins.select(F.col("id").alias("doc_id"), "part", F.col("size").alias("n_tokens"), F.col("bin").alias("bin_id"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train_residue_model(docs, "doc_id", "text", "source")
    return find_residue(docs, "doc_id", "text", model).select(F.col("id").alias("doc_id"))


def p8_validation(spark: SparkSession, folder: str) -> DataFrame:
    """How the classifier does on sentences of hosts that took no part in its fit, against the weak labels."""
    found = train_residue_model(table(spark, folder, "documents"), "doc_id", "text", "source").validation
    return spark.createDataFrame(sorted(found.items()), "measure string, value double")


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p2_found": p2_found, "p2_forms": p2_forms, "p6_ids": p6_ids, "p7_bins": p7_bins, "p8_found": p8_found, "p8_validation": p8_validation}

_P1 = """
WITH q AS (SELECT DISTINCT query_id AS b, unnest(candidate_track_uris) AS item FROM track_reranking_split),
e AS (SELECT DISTINCT event_id, user_id, epoch_us(ts) AS us, track_name_key FROM streaming_history WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT user_id, track_name_key AS item, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
i AS (SELECT DISTINCT 'query' AS basket, b, item FROM q WHERE item IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT DISTINCT 'session', user_id || '/' || run, item FROM s WHERE item <> ''),
n AS (SELECT basket, count(DISTINCT b) AS n FROM i GROUP BY basket),
c AS (SELECT basket, item, count(*) AS n_item FROM i GROUP BY ALL),
p AS (SELECT x.basket, x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM i x JOIN i y ON x.basket = y.basket AND x.b = y.b AND x.item < y.item GROUP BY ALL HAVING count(*) >= 5),
s4 AS (SELECT p.basket, item_a, item_b, n_ab, ca.n_item AS n_a, cb.n_item AS n_b, n FROM p JOIN n ON n.basket = p.basket JOIN c ca ON ca.basket = p.basket AND ca.item = item_a JOIN c cb ON cb.basket = p.basket AND cb.item = item_b)
"""
_P1_FOUND = _P1 + "SELECT basket, item_a, item_b FROM s4 WHERE n_ab * n >= 5 * n_a * n_b"
_CELLS = ["n_ab", "n_a - n_ab", "n_b - n_ab", "n - n_a - n_b + n_ab", "n_a", "n - n_a", "n_b", "n - n_b", "n"]
_SIGNS = [1, 1, 1, 1, -1, -1, -1, -1, 1]
_LLR = " + ".join(f"{sign} * CASE WHEN {x} > 0 THEN ({x}) * ln(({x})::DOUBLE) ELSE 0 END" for sign, x in zip(_SIGNS, _CELLS))
_P1_SCORES = (
    _P1
    + f"""SELECT basket, item_a, item_b, n_ab, n_a, n_b, n, round(n_ab * n::DOUBLE / (n_a * n_b::DOUBLE), 6) AS ratio, round(greatest(0, 2 * ({_LLR})), 4) AS llr
FROM s4 WHERE n_ab * n >= n_a * n_b AND 2 * ({_LLR}) >= {SIGNIFICANT}"""
)

_P2 = f"""
WITH e AS (SELECT DISTINCT event_id, artist_name AS a FROM streaming_history WHERE artist_name IS NOT NULL), d AS (SELECT DISTINCT a FROM e),
l AS (SELECT a, {look_sql("a")} AS look FROM d), p AS (SELECT ref_id, name, {look_sql("name")} AS look FROM public_listening_row WHERE dimension = 'artists' AND name IS NOT NULL)
SELECT DISTINCT event_id, ref_id FROM l JOIN p USING (look) JOIN e USING (a) WHERE look <> '' AND a <> name"""

ORACLE = {"p1_found": _P1_FOUND, "p1_scores": _P1_SCORES, "p2_found": _P2}

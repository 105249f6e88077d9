"""The queries p3 to p5 over the tables of a data folder, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.gaptree import forest_sessions, gap_forest, gap_sessions
from tessitura.operators.rolling import daily_totals, trailing_totals
from tessitura.operators.topn import top_n
from tessitura.tables import table

SESSION_GAP_US = 1_800_000_000
GAP_SETTINGS_US = (600_000_000, 1_800_000_000, 7_200_000_000)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = gap_sessions(table(spark, folder, "streaming_history"), "user_id", "ts", "event_id", "artist_key", gaps_us=(SESSION_GAP_US,))
    return found.select(F.col("entity").alias("user_id"), "start_us", "end_us", "event_count", F.col("key_count").alias("artist_count"))


def p3_gap_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions for gaps of 10 minutes, 30 minutes and 2 hours, cut from one stored forest."""
    forest = gap_forest(table(spark, folder, "streaming_history"), "user_id", "ts", "event_id", "artist_key")
    found = forest_sessions(forest, GAP_SETTINGS_US)
    return found.select("gap_us", F.col("entity").alias("user_id"), "start_us", "end_us", "event_count", F.col("key_count").alias("artist_count"))


def p4_trailing(spark: SparkSession, folder: str) -> DataFrame:
    """All days of all users, with totals and averages over 7 and 30 days."""
    totals = trailing_totals(daily_totals(table(spark, folder, "streaming_history"), "user_id", "ts", "event_id", "ms_played"))
    return totals.withColumn("listening_date", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd")).withColumnRenamed("entity", "user_id").drop("day")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_trailing(spark, folder).where("10 * amount_7 > 7 * amount_30").select("user_id", "listening_date")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    best = top_n(table(spark, folder, "creator_ranking_opportunities"), "report_family_id", "opportunity_score", "opportunity_id", 5)
    return best.select(F.col("bin").alias("report_family_id"), F.col("id").alias("opportunity_id"))


QUERIES = {"p3_found": p3_found, "p3_gap_settings": p3_gap_settings, "p4_found": p4_found, "p4_trailing": p4_trailing, "p5_found": p5_found}

_EVENTS = "SELECT DISTINCT event_id, user_id, epoch_us(ts) AS us, artist_key, ms_played FROM streaming_history WHERE user_id IS NOT NULL AND ts IS NOT NULL"
_DAYS = f"""
WITH e AS ({_EVENTS}),
d AS (SELECT user_id, date '1970-01-01' + CAST(us // 86400000000 AS INTEGER) AS day, count(*) AS plays, CAST(sum(greatest(coalesce(ms_played, 0), 0)) AS BIGINT) AS amount FROM e GROUP BY ALL),
span AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY user_id),
c AS (SELECT s.user_id, s.day, coalesce(d.plays, 0) AS plays, coalesce(d.amount, 0) AS amount FROM span s LEFT JOIN d USING (user_id, day)),
t AS (SELECT *, CAST(sum(plays) OVER w7 AS BIGINT) AS plays_7, CAST(sum(amount) OVER w7 AS BIGINT) AS amount_7, CAST(sum(plays) OVER w30 AS BIGINT) AS plays_30, CAST(sum(amount) OVER w30 AS BIGINT) AS amount_30 FROM c
  WINDOW w7 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

ORACLE = {
    "p3_found": f"""
WITH e AS ({_EVENTS}),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {SESSION_GAP_US} THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS event_count, count(DISTINCT nullif(artist_key, '')) AS artist_count FROM s GROUP BY user_id, run""",
    "p3_gap_settings": f"""
WITH e AS ({_EVENTS}), k AS (SELECT e.*, gap_us FROM e, (VALUES {", ".join(f"({g})" for g in GAP_SETTINGS_US)}) v(gap_us)),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > gap_us THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY gap_us, user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY gap_us, user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT gap_us, user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS event_count, count(DISTINCT nullif(artist_key, '')) AS artist_count FROM s GROUP BY gap_us, user_id, run""",
    "p4_found": _DAYS + "SELECT user_id, strftime(day, '%Y-%m-%d') AS listening_date FROM t WHERE 10 * amount_7 > 7 * amount_30",
    "p4_trailing": _DAYS
    + """SELECT user_id, strftime(day, '%Y-%m-%d') AS listening_date, plays, amount, plays_7, amount_7, plays_30, amount_30,
  plays_7 / 7.0::DOUBLE AS plays_avg_7, amount_7 / 7.0::DOUBLE AS amount_avg_7, plays_30 / 30.0::DOUBLE AS plays_avg_30, amount_30 / 30.0::DOUBLE AS amount_avg_30 FROM t""",
    "p5_found": """
WITH r AS (SELECT DISTINCT report_family_id, opportunity_id, opportunity_score FROM creator_ranking_opportunities
  WHERE report_family_id IS NOT NULL AND opportunity_score IS NOT NULL AND NOT isnan(opportunity_score))
SELECT report_family_id, opportunity_id FROM r QUALIFY row_number() OVER (PARTITION BY report_family_id ORDER BY opportunity_score DESC, opportunity_id) <= 5""",
}

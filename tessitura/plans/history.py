"""The listening history in one clean form, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.scalars import device_family, text_or_null, tri_state
from tessitura.operators.rolling import utc_day
from tessitura.tables import table


def history(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Events with user and time, each once, days in UTC: the given columns, or all.

    Rows that repeat an event_id are dropped by a shuffle on event_id, which no hot key skews. Repeats differ in
    ingested_at only, so with `columns` they are equal rows: these are dropped by a hash aggregate over what the query
    reads, without a sort.
    """
    raw = table(spark, folder, "streaming_history").where("user_id is not null and ts is not null").drop("ingested_at", "listening_date")
    platform = F.lower(text_or_null(F.col("platform")))
    made = {
        "ms": F.greatest(F.coalesce("ms_played", F.lit(0)), F.lit(0)),
        "skip": F.coalesce(tri_state(F.col("skipped")), F.lit(False)),
        "artist": F.coalesce("artist_key", F.lit("")),
        "track": F.coalesce("track_name_key", F.lit("")),
        "platform": platform,
        "family": device_family(platform),
        "day": F.date_from_unix_date(utc_day("ts")),
    }
    if columns:
        return raw.withColumns(made).select("event_id", *(c for c in dict.fromkeys(columns) if c != "event_id")).distinct()
    return raw.dropDuplicates(["event_id"]).withColumns(made)


SQL = """h AS (SELECT DISTINCT event_id, user_id, ts AT TIME ZONE 'UTC' AS ts, epoch_us(ts) AS us, greatest(coalesce(ms_played, 0), 0) AS ms,
  coalesce(lower(trim(skipped)) IN ('true', '1', 'yes', 'y', 't'), false) AS skip, coalesce(artist_key, '') AS artist, coalesce(track_name_key, '') AS track,
  nullif(lower(trim(platform)), '') AS platform, media_type, artist_name, reason_start, reason_end, shuffle, offline, conn_country, track_uri, episode_uri, CAST(ts AT TIME ZONE 'UTC' AS DATE) AS day
  FROM streaming_history WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""

"""Typed reads of a daily similarity table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = {"listening_date", "dimension", "event_count", "duration_minutes", "global_similarity", "united_states_similarity", "closer_scope", "reference_alignment"}
SCOPES = {"global", "united_states", "tie"}


@dataclass(frozen=True)
class ListeningQuery:
    """Filters; None takes everything."""

    start: str | None = None
    end: str | None = None
    dimension: str | None = None
    alignment: str | None = None
    closer_scope: str | None = None
    least_events: int | None = None


def _date(value: str | None, name: str) -> dt.date | None:
    try:
        return None if value is None else dt.date.fromisoformat(value)
    except ValueError:
        raise ValueError(f"{name} is no date: {value}") from None


class ListeningService:
    """Over exactly one of a DataFrame, a Parquet path or a table's name. Filters reach the scan."""

    def __init__(self, spark: SparkSession, *, frame: DataFrame | None = None, parquet: str | None = None, name: str | None = None) -> None:
        given = [x for x in (frame, parquet, name) if x is not None]
        if len(given) != 1:
            raise ValueError("give exactly one of frame, parquet and name")
        self.df = frame if frame is not None else spark.read.parquet(parquet) if parquet else spark.table(name)
        if missing := REQUIRED - set(self.df.columns):
            raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
        self.df = self.df.withColumn("listening_date", F.col("listening_date").cast("date"))

    def rows(self, query: ListeningQuery = ListeningQuery()) -> DataFrame:
        start, end = _date(query.start, "start"), _date(query.end, "end")
        if start and end and start > end:
            raise ValueError("start is after end")
        if query.closer_scope is not None and query.closer_scope not in SCOPES:
            raise ValueError(f"closer_scope is one of {', '.join(sorted(SCOPES))}")
        if query.least_events is not None and query.least_events < 0:
            raise ValueError("least_events is negative")
        df = self.df
        for wanted, condition in (
            (start, lambda x: F.col("listening_date") >= F.lit(x)), (end, lambda x: F.col("listening_date") <= F.lit(x)), (query.dimension, lambda x: F.col("dimension") == x),
            (query.alignment, lambda x: F.col("reference_alignment") == x), (query.closer_scope, lambda x: F.col("closer_scope") == x), (query.least_events, lambda x: F.col("event_count") >= x),
        ):
            if wanted is not None:
                df = df.where(condition(wanted))
        return df

    def date_range(self, query: ListeningQuery = ListeningQuery()) -> DataFrame:
        return self.rows(query).agg(F.min("listening_date").alias("first"), F.max("listening_date").alias("last"))

    def daily_trend(self, query: ListeningQuery = ListeningQuery(), limit: int | None = None) -> DataFrame:
        df = self.rows(query).orderBy("listening_date", "dimension")
        if limit is not None and limit < 1:
            raise ValueError("limit is under 1")
        return df if limit is None else df.limit(limit)

    def values(self, column: str, query: ListeningQuery = ListeningQuery()) -> DataFrame:
        if column not in ("dimension", "reference_alignment", "closer_scope"):
            raise ValueError(f"no list of {column}")
        return self.rows(query).where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)

    def summary(self, query: ListeningQuery = ListeningQuery()) -> DataFrame:
        return self.rows(query).agg(
            F.count_distinct("listening_date").alias("days"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"), F.round(F.coalesce(F.sum("duration_minutes"), F.lit(0.0)), 6).alias("minutes"),
            F.round(F.coalesce(F.avg("global_similarity"), F.lit(0.0)), 9).alias("mean_global"), F.round(F.coalesce(F.avg("united_states_similarity"), F.lit(0.0)), 9).alias("mean_united_states"),
            F.round(F.max(F.greatest("global_similarity", "united_states_similarity")), 9).alias("best"), F.count_if(F.col("closer_scope") == "global").alias("closer_global"),
        )

    def notable_days(self, most: int, *, alike: bool = True, query: ListeningQuery = ListeningQuery()) -> DataFrame:
        """The days most (or least) like either list, of equals the later."""
        best = F.greatest("global_similarity", "united_states_similarity")
        df = self.rows(query).withColumn("similarity", best).where("similarity is not null")
        return df.orderBy(F.desc("similarity") if alike else F.asc("similarity"), F.desc("listening_date"), "dimension").limit(most).select("listening_date", "dimension", "similarity", "closer_scope")


def narratives(daily: DataFrame) -> DataFrame:
    """Per day: the closest scope and dimension (ties within 1e-12 named together), events, and a headline with its caveats."""
    sides = daily.select("listening_date", "dimension", "event_count", F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), F.col(f"{s}_similarity").alias("v")) for s in ("global", "united_states")))).alias("s")).select("listening_date", "dimension", "event_count", "s.*")
    best = sides.groupBy("listening_date").agg(F.max("v").alias("best"))
    tied = sides.join(best, "listening_date").where("best - v <= 1e-12").groupBy("listening_date").agg(F.first("best").alias("similarity"), F.array_sort(F.collect_set("scope")).alias("scopes"), F.array_sort(F.collect_set("dimension")).alias("dimensions"))
    total = daily.groupBy("listening_date").agg(F.sum("event_count").alias("events"))
    text = F.format_string("Closest to %s in %s (%.2f) over %d plays", F.concat_ws(" and ", "scopes"), F.concat_ws(", ", "dimensions"), "similarity", "events")
    caveat = F.when(F.col("events") < 10, F.lit("few plays")).when(F.size("scopes") > 1, F.lit("both lists are equally close")).otherwise("")
    return tied.join(total, "listening_date").select("listening_date", "similarity", F.concat_ws("|", "scopes").alias("scopes"), F.concat_ws("|", "dimensions").alias("dimensions"), "events", text.alias("headline"), caveat.alias("caveat"))

"""Totals and averages over trailing days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def utc_day(time: str) -> Column:
    """Days since 1970-01-01 UTC of a timestamp, whatever the session's time zone."""
    us = f"unix_micros(cast(`{time}` as timestamp))"
    return F.expr(f"cast(({us} - pmod({us}, {DAY_US}L)) div {DAY_US}L as int)")


def daily_totals(events: DataFrame, entity: str, time: str, event_id: str, measure: str) -> DataFrame:
    """entity, day (days since 1970-01-01 UTC), plays, amount: sparse, one row per day with an event.

    One shuffle, by entity and day, does for dropping repeats and for the totals. Rows without entity or time are left
    out; repeats of an event_id (same entity, time and measure) count once, rows with a null event_id each; null, NaN
    and negative measures count as 0.
    """
    amount = F.greatest(F.coalesce(F.nanvl(F.col(measure).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).cast("long") if dict(events.dtypes)[measure] in ("float", "double") else F.greatest(F.coalesce(F.col(measure).cast("long"), F.lit(0)), F.lit(0))
    own_id: Column = F.when(F.col(event_id).isNull(), F.monotonically_increasing_id())
    rows = events.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).select(
        F.col(entity).cast("string").alias("entity"), utc_day(time).alias("day"), F.col(event_id).alias("event_id"), own_id.alias("own_id"), amount.alias("amount")
    )
    once = rows.repartition("entity", "day").groupBy("entity", "day", "event_id", "own_id").agg(F.max("amount").alias("amount"))
    return once.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("plays"), F.sum("amount").alias("amount"))


def trailing_totals(daily: DataFrame, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """For every day from an entity's first to its last: plays, amount and, per period n, plays_n, amount_n and their
    averages over n days (plays_avg_n, amount_avg_n), with the fixed denominator n: days before the first count as 0.

    Takes daily_totals(). Calendar rows for days without events come from the gap to the next day with one, so no
    calendar is joined; range frames over day numbers then sum whatever lies in the period. An entity's days, not its
    events, are what one task orders.
    """
    order = Window.partitionBy("entity").orderBy("day")
    until = F.coalesce(F.lead("day").over(order) - 1, F.col("day"))
    calendar = daily.withColumn("until", until).select("entity", F.explode(F.sequence("day", "until")).alias("on"), F.col("day").alias("day"), "plays", "amount")
    active = F.col("on") == F.col("day")
    calendar = calendar.select("entity", F.col("on").alias("day"), *(F.when(active, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("plays", "amount")))
    totals = [F.sum(c).over(order.rangeBetween(1 - n, 0)).alias(f"{c}_{n}") for n in periods for c in ("plays", "amount")]
    result = calendar.select("*", *totals)
    return result.select("*", *((F.col(f"{c}_{n}") / F.lit(n)).alias(f"{c}_avg_{n}") for n in periods for c in ("plays", "amount")))

"""How alike a listener's ranks and the public's are, per day, and how that develops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_entities(events: DataFrame, group: Sequence[str], key: str, ms: str, by: str = "n") -> DataFrame:
    """Per group and key: n, ms and its rank by n (or ms), then the other, then the key."""
    total = events.groupBy(*group, key).agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("ms"))
    other = "ms" if by == "n" else "n"
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by), F.desc(other), key)).cast("long"))


def rank_weighted_jaccard(left: DataFrame, right: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Per group of left: sum of the smaller over sum of the larger reciprocal rank of all keys of either; similarity 0 without any.

    right has ranks by key, for all groups alike. A key's smaller weight is 0 where it is in one list only, so only
    keys of both lists need to be joined; the rest comes from the sums of weights.
    """
    total = right.agg(F.sum(1 / F.col("rank")).alias("_all"))
    mine = left.groupBy(*group).agg(F.sum(1 / F.col("rank")).alias("_mine"))
    both = left.select(*group, key, (1 / F.col("rank")).alias("_a")).join(right.select(key, (1 / F.col("rank")).alias("_b")), key)
    shared = both.groupBy(*group).agg(F.sum(F.least("_a", "_b")).alias("_min"), F.count(F.lit(1)).alias("shared"))
    joined = mine.join(shared, list(group), "left").join(F.broadcast(total)).fillna(0, ["_min", "shared"])
    return joined.select(*group, "shared", F.round(F.coalesce(F.col("_min") / F.nullif(F.col("_mine") + F.col("_all") - F.col("_min"), F.lit(0.0)), F.lit(0.0)), 9).alias("similarity"))


def trailing_trend(daily: DataFrame, keys: Sequence[str], day: str, value: str, periods: Sequence[int] = (7, 30), lags: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """Mean and population deviation over the days (t - n, t], and the change to the value exactly so many days before (null without one)."""
    at = F.unix_date(F.col(day))
    w = Window.partitionBy(*keys).orderBy("_d")
    rows = daily.withColumn("_d", at)
    made = {}
    for n in periods:
        frame = w.rangeBetween(1 - n, 0)
        made[f"{value}_mean_{n}d"], made[f"{value}_std_{n}d"] = F.round(F.avg(value).over(frame), 12), F.round(F.stddev_pop(value).over(frame), 12)
    for n in lags:
        made[f"{value}_delta_{n}d"] = F.round(F.col(value) - F.max(value).over(w.rangeBetween(-n, -n)), 9)
    return rows.withColumns(made).drop("_d")


def closer_streaks(daily: DataFrame, keys: Sequence[str], day: str, a: str, b: str, names: tuple[str, str]) -> DataFrame:
    """closer (name of the larger value, or tie) and for how many days in a row it has been; 0 for a tie, 1 after a missing day."""
    rows = daily.withColumn("closer", F.when(F.col(a) > F.col(b), names[0]).when(F.col(a) < F.col(b), names[1]).otherwise("tie"))
    island = F.unix_date(F.col(day)) - F.row_number().over(Window.partitionBy(*keys, "closer").orderBy(day))
    rows = rows.withColumn("_i", island)
    length = F.row_number().over(Window.partitionBy(*keys, "closer", "_i").orderBy(day))
    return rows.withColumn("streak", F.when(F.col("closer") == "tie", 0).otherwise(length).cast("long")).drop("_i")


def deviations(daily: DataFrame, keys: Sequence[str], day: str, value: str, days: int = 30, least: int = 14, limit: float = 3.5) -> DataFrame:
    """Robust z of each day's value against the days before it (by median and median absolute deviation), null with fewer than `least` of them; is_anomaly."""
    w = Window.partitionBy(*keys).orderBy("_d").rangeBetween(-days, -1)

    def median(xs):
        s, n = F.array_sort(xs), F.size(xs)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2

    known = F.when(~F.isnan(value), F.col(value))
    rows = daily.withColumn("_d", F.unix_date(F.col(day))).withColumn("_h", F.collect_list(known).over(w))
    rows = rows.withColumn("_m", F.when(F.size("_h") >= least, median(F.col("_h")))).withColumn("_a", F.when(F.size("_h") >= least, median(F.transform("_h", lambda x: F.abs(x - F.col("_m"))))))
    z = F.abs(F.col(value) - F.col("_m")) / F.greatest(1.4826 * F.col("_a"), F.lit(1e-9))
    return rows.withColumn("z", z).withColumn("is_anomaly", F.coalesce(F.col("z") >= limit, F.lit(False))).drop("_d", "_h", "_m", "_a")


def weekly_mean(daily: DataFrame, keys: Sequence[str], day: str, value: str, weight: str) -> DataFrame:
    """Weighted mean per week from Monday."""
    week = F.to_date(F.date_trunc("week", F.col(day)))
    return daily.groupBy(*keys, week.alias("week")).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0)), 9).alias(value), F.sum(weight).alias(weight))


def fractional_shares(events: DataFrame, tags: DataFrame, key: str, tag: str, ident: str, measure: str) -> DataFrame:
    """Per tag: events and measure, where an event with k tags counts 1/k for each; events without tags are left out."""
    per = tags.select(key, tag).distinct()
    per = per.withColumn("_w", 1 / F.count(F.lit(1)).over(Window.partitionBy(key)))
    return events.select(key, ident, measure).join(per, key).groupBy(tag).agg(F.round(F.sum("_w"), 6).alias("events"), F.round(F.sum(F.col("_w") * F.col(measure)), 3).alias(measure))


def regime_shifts(monthly: DataFrame, month: str, label: str, n: str) -> DataFrame:
    """Per month after the first: half the sum of absolute changes of shares against the month before, largest gain and loss (of equals the smaller label)."""
    share = monthly.withColumn("_s", F.col(n) / F.sum(n).over(Window.partitionBy(month)))
    grid = share.select(month).distinct().withColumn("_before", F.lag(month).over(Window.orderBy(month)))
    now = grid.where("_before is not null").join(share.select(month, label, F.col("_s").alias("d")), month)
    old = grid.where("_before is not null").join(share.select(F.col(month).alias("_before"), label, (-F.col("_s")).alias("d")), "_before")
    change = now.select(month, label, "d").unionByName(old.select(month, label, "d")).groupBy(month, label).agg(F.round(F.sum("d"), 9).alias("d"))
    pick = lambda sign: F.min(F.struct((F.lit(-sign) * F.col("d")).alias("k"), F.col(label).alias("l")))["l"]
    return change.groupBy(month).agg(F.round(0.5 * F.sum(F.abs("d")), 10).alias("shift"), pick(1).alias("gain"), pick(-1).alias("loss"))

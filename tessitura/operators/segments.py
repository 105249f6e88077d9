"""Segments of events, metrics and drift by segment, and baselines of the next item."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.relations import quantiles


def segment_columns(hour: str, dow: str, position: str, repeats: str, skip: str) -> dict[str, Column]:
    """Buckets of an event by hour, weekend, phase of the session, repeat and skip; a missing value counts as 0."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return {
        "hour_bucket": F.when((n(hour) >= 5) & (n(hour) < 12), "morning").when((n(hour) >= 12) & (n(hour) < 17), "afternoon").when((n(hour) >= 17) & (n(hour) < 22), "evening").otherwise("night"),
        "is_weekend": F.when(n(dow) >= 5, "weekend").otherwise("weekday"),
        "session_phase": F.when(n(position) < 3, "early").when(n(position) < 10, "mid").otherwise("late"),
        "repeat_from_prev": F.when(n(repeats) > 0, "repeat").otherwise("new"),
        "skip_flag": F.when(n(skip) > 0, "skip").otherwise("no_skip"),
    }


def with_regimes(df: DataFrame, friction: Sequence[str], repeat_ratio: str, platform: str) -> DataFrame:
    """friction_regime, repeat_regime and platform_bucket: by the sum of what the friction columns have above their medians
    (high from its upper quartile on), by the median of the repeat ratio, and by platform. Thresholds are exact and joined as one row."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = df
    for i, c in enumerate(friction):
        rows = rows.join(F.broadcast(quantiles(df.select(n(c).alias("x")), "x", [0.5]).select(F.col("q0").alias(f"_m{i}"))))
    score = sum((F.greatest(n(c) - F.col(f"_m{i}"), F.lit(0.0)) for i, c in enumerate(friction)), F.lit(0.0))
    rows = rows.withColumn("_score", score)
    limits = quantiles(rows.select("_score"), "_score", [0.75]).select(F.col("q0").alias("_high")).join(quantiles(rows.select(n(repeat_ratio).alias("x")), "x", [0.5]).select(F.col("q0").alias("_mid")))
    made = {
        "friction_regime": F.when(F.col("_score") >= F.col("_high"), "high_friction").otherwise("normal_friction") if friction else F.lit("unknown"),
        "repeat_regime": F.when(n(repeat_ratio) >= F.col("_mid"), "repeat_heavy").otherwise("repeat_light"),
        "platform_bucket": F.concat(F.lit("platform_"), F.coalesce(F.col(platform).cast("string"), F.lit("-1"))),
    }
    return rows.join(F.broadcast(limits)).withColumns(made).drop("_score", "_high", "_mid", *(f"_m{i}" for i in range(len(friction))))


def segment_metrics(df: DataFrame, segments: Sequence[str], correct: str, confidence: str) -> DataFrame:
    """(segment, bucket, count, top1, mean_confidence), all segments in one pass."""
    pairs = F.array(*(F.struct(F.lit(s).alias("segment"), F.col(s).alias("bucket")) for s in segments))
    rows = df.select(F.explode(pairs).alias("s"), F.col(correct).cast("int").alias("_r"), F.col(confidence).alias("_c"))
    return rows.groupBy("s.segment", "s.bucket").agg(F.count(F.lit(1)).alias("count"), F.avg("_r").alias("top1"), F.avg("_c").alias("mean_confidence"))


def top_errors(df: DataFrame, truth: str, predicted: str, most: int = 25) -> DataFrame:
    """The most frequent pairs of true and wrongly predicted labels; of equals in order of name."""
    n = df.where(F.col(truth) != F.col(predicted)).groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("count"))
    return n.orderBy(F.desc("count"), truth, predicted).limit(most)


def feature_group(name: str) -> Column:
    """The family of a feature by its name."""
    c = F.trim(F.col(name))
    temporal = ["hour", "dayofweek", "dow", "month", "time_diff", "session_position", "session_elapsed_seconds", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
    behaviour = "skip|repeat|artist_|item_|transition|session_|listen_|days_since|hours_since|plays_"
    technical = c.startswith("tech_") | (c == "offline")
    return F.when(c == "", "other").when(technical, "technical").when(c.isin(temporal), "temporal").when(c.rlike(behaviour), "behavioral").when(c.isin("danceability", "energy", "tempo"), "content").otherwise("other")


def drift_groups(drift: DataFrame, feature: str, shift: str) -> DataFrame:
    """Per family of features: how many, mean and largest absolute shift, and the feature that has it (of equals the first by name)."""
    rows = drift.withColumn("_a", F.abs(shift)).where("_a is not null and not isnan(_a)").groupBy(feature_group(feature).alias("feature_group"))
    return rows.agg(F.count(F.lit(1)).alias("feature_count"), F.avg("_a").alias("mean_shift"), F.max("_a").alias("max_shift"), F.min_by(feature, F.struct((-F.col("_a")).alias("a"), F.col(feature).alias("n"))).alias("top_feature"))


def low_drift(report: DataFrame, shift: str, distance: str, most_shift: float = 0.2, most_distance: float = 0.2) -> DataFrame:
    """low_drift: both measures are there and small."""
    return report.withColumn("low_drift", F.coalesce((F.abs(shift) <= most_shift) & (F.col(distance) <= most_distance), F.lit(False)))


def drift_report(df: DataFrame, split: str, a: str, b: str, features: Sequence[str], bins: int = 20) -> DataFrame:
    """(feature, shift, distance): standardized difference of means (pooled deviation; 1 where that is 0) and Jensen-Shannon distance
    over equal bins of the joint range, base 2, of every feature between two splits. Two passes for all features."""
    rows = df.where(F.col(split).isin(a, b)).select((F.col(split) == b).alias("_b"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("s")).select("_b", "s.*").where("x is not null and not isnan(x)")
    of = lambda f, side: f(F.when(F.col("_b") == F.lit(side), F.col("x")))
    pooled = F.sqrt((of(F.var_pop, False) + of(F.var_pop, True)) / 2)
    stats = rows.groupBy("feature").agg(((of(F.avg, True) - of(F.avg, False)) / F.when(pooled > 0, pooled).otherwise(1.0)).alias("shift"), F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.count_if(F.col("_b")).alias("_nb"), F.count_if(~F.col("_b")).alias("_na"))
    place = F.least(F.coalesce(F.floor((F.col("x") - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")) / bins, F.lit(0.0))), F.lit(0)), F.lit(bins - 1))
    cells = rows.join(F.broadcast(stats), "feature").groupBy("feature", place.alias("bin")).agg((F.count_if(~F.col("_b")) / F.max("_na")).alias("p"), (F.count_if(F.col("_b")) / F.max("_nb")).alias("q"))
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / ((F.col("p") + F.col("q")) / 2))).otherwise(0.0)
    js = cells.groupBy("feature").agg(F.sqrt(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0))).alias("distance"))
    return stats.select("feature", "shift").join(js, "feature")


def next_item_baselines(train: DataFrame, test: DataFrame, before: str, item: str) -> DataFrame:
    """One row: accuracy on test of the most frequent item of train, of the item before, and of the most frequent successor in train
    of the item before (of equals the first by name; the first item of all where it has none)."""
    n = train.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    majority = n.agg(F.min_by(item, F.struct(-F.col("n"), F.col(item))).alias("_majority"), F.min(item).alias("_first"))
    follows = train.where(F.col(before).isNotNull()).groupBy(before, item).agg(F.count(F.lit(1)).alias("n"))
    best = follows.groupBy(before).agg(F.min_by(item, F.struct(-F.col("n"), F.col(item))).alias("_next"))
    rows = test.where(F.col(before).isNotNull()).join(best, before, "left").join(F.broadcast(majority))
    hit = lambda c: F.avg((c == F.col(item)).cast("int"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), hit(F.col("_majority")).alias("majority_top1"), hit(F.col(before)).alias("last_item_top1"), hit(F.coalesce("_next", "_first")).alias("markov_top1"))


def policy_rewards(train: DataFrame, test: DataFrame, ident: str, before: str, item: str, seen: str, k: int = 5) -> DataFrame:
    """One row: hit at k, mean discounted reward and mean utility of the k most frequent successors of the item before.

    An item's utility mixes its smoothed transition share (0.65), whether the session has it (0.20) and how rare it is in
    train (0.15), and is scaled to sum 1 over all items: the sums are known without listing all items. seen: the array of
    items of the session so far.
    """
    items = train.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    total = items.agg(F.count(F.lit(1)).alias("_v"), F.sum("_n").alias("_t"))
    follows = train.where(F.col(before).isNotNull()).groupBy(before, item).agg(F.count(F.lit(1)).alias("_c"))
    out = follows.groupBy(before).agg(F.sum("_c").alias("_out"))
    place = F.row_number().over(Window.partitionBy(before).orderBy(F.desc("_c"), item))
    lists = follows.withColumn("_place", place).where(F.col("_place") <= k).withColumnRenamed(item, "_candidate").join(out, before)
    rows = test.where(F.col(before).isNotNull()).join(lists, before).join(items.select(F.col(item).alias("_candidate"), "_n"), "_candidate").join(F.broadcast(total))
    smooth = (F.col("_c") + 1) / (F.col("_out") + F.col("_v"))
    rare = 1 - (F.col("_n") + 1) / (F.col("_t") + F.col("_v"))
    whole = 0.65 + 0.20 * F.size(F.array_distinct(seen)) + 0.15 * (F.col("_v") - 1)
    utility = (0.65 * smooth + 0.20 * F.array_contains(seen, F.col("_candidate")).cast("int") + 0.15 * rare) / whole
    per = rows.groupBy(ident).agg(F.max((F.col("_candidate") == F.col(item)).cast("int")).alias("hit"), F.sum(utility / F.log2(F.col("_place") + 1)).alias("reward"), F.sum(utility).alias("mass"))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.avg("hit").alias("hit_at_k"), F.avg("reward").alias("discounted_reward"), F.avg("mass").alias("utility_mass"))


def labelled_profile(df: DataFrame, labels: DataFrame, label: str, means: Mapping[str, str]) -> DataFrame:
    """A row for every label, with plays and means of its events; 0 where it has none."""
    stats = df.groupBy(label).agg(F.count(F.lit(1)).alias("play_count"), *(F.avg(F.col(c).cast("double")).alias(n) for n, c in means.items()))
    return labels.join(stats, label, "left").fillna(0)

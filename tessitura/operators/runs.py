"""Marts of model runs and of report families: joins, ranks, best and latest rows.

Values that are no number count as missing. Of equal rows the one with the smaller name comes first, so that a result is
the same on every run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.scalars import listed, number, truth
from tessitura.operators.relations import mode_of, rank_present, scaled

PRIORITY, WATCH = "priority_now", "watchlist"


def _value(name: str) -> Column:
    return number(F.col(name))


def best_row(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], *order: Column) -> DataFrame:
    """Per key the values of the first row in an order, by one aggregate: no group is sorted. Orders are smallest first, nulls last."""
    place = [x for i, o in enumerate(order) for x in (o.isNull().alias(f"n{i}"), o.alias(f"o{i}"))]
    first = F.min_by(F.struct(*(v.alias(n) for n, v in values.items())), F.struct(*place)).alias("_best")
    return df.groupBy(*keys).agg(first).select(*keys, "_best.*")


def share_of(value: str, wanted: str) -> Column:
    return F.count_if(F.col(value) == wanted)


def run_summary(manifests: DataFrame, results: DataFrame, backtests: DataFrame) -> DataFrame:
    """A row for every result of a run: its manifest, the mean of its model's backtests, dense ranks by validation and test score in the run, and whether it is the model served."""
    about = manifests.withColumnRenamed("champion_gate_promoted", "promoted")
    folds = backtests.groupBy("run_id", "model_name").agg(F.avg(_value("top1")).alias("mean_backtest_top1"), F.count(_value("top1")).alias("backtest_folds"))
    rows = results.withColumns({"val_top1": _value("val_top1"), "test_top1": _value("test_top1")})
    rows = rows.join(about, "run_id", "left").join(folds, ["run_id", "model_name"], "left")
    for split in ("val", "test"):
        rows = rank_present(rows, ["run_id"], f"{split}_top1", f"{split}_rank_within_run")
    return rows.withColumn("is_serving_alias", F.coalesce(F.col("model_name") == F.col("champion_alias_model_name"), F.lit(False)))


def run_quality(summary: DataFrame) -> DataFrame:
    """Per run: its manifest, the best model by test and then validation score, and how many models it has."""
    about = ["run_name", "profile", "run_timestamp", "promoted", "champion_gate_status", "champion_gate_metric_source", "data_records"]
    values = {c: F.col(c) for c in about} | {"serving_model_name": F.col("champion_alias_model_name"), "serving_model_type": F.col("champion_alias_model_type")}
    values |= {f"best_{c}": F.col(c) for c in ("model_name", "model_type", "val_top1", "test_top1", "mean_backtest_top1")}
    best = best_row(summary, ["run_id"], values, -F.col("test_top1"), -F.col("val_top1"), F.col("model_name"), F.col("model_type"))
    return best.join(summary.groupBy("run_id").agg(F.count("model_name").alias("models_evaluated")), "run_id")


def model_registry(summary: DataFrame) -> DataFrame:
    """Per model and type: runs, promoted runs, means and the best of its scores, its usual family, and its latest run."""
    keys = ["model_name", "model_type"]
    mean = lambda c: F.avg(_value(c)).alias(f"mean_{c}")
    total = summary.groupBy(*keys).agg(
        F.count_distinct("run_id").alias("runs"),
        F.count_if(truth(F.col("promoted"))).alias("promoted_runs"),
        *(mean(c) for c in ("val_top1", "test_top1", "mean_backtest_top1", "fit_seconds")),
        F.max(_value("test_top1")).alias("max_test_top1"),
    ).withColumnRenamed("mean_mean_backtest_top1", "mean_backtest_top1")
    latest = F.max_by(F.struct("run_id", "profile", "run_timestamp"), F.struct("run_timestamp", "run_id")).alias("l")
    last = summary.groupBy(*keys).agg(latest).select(*keys, F.col("l.run_id").alias("latest_run_id"), F.col("l.profile").alias("latest_profile"), F.col("l.run_timestamp").alias("latest_run_timestamp"))
    return total.join(last, keys).join(mode_of(summary, keys, "model_family", "model_family"), keys, "left")


def run_registry(manifests: DataFrame, artifacts: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Per run: which of the wanted artifacts it has, their share, and its stage: complete, partial or bare. artifacts: (run_id, name), names of files without their ending.

    Runs without an artifact are bare; artifacts of unknown runs and other names are left out, repeated ones count once.
    """
    held = artifacts.where(F.col("name").isin(*wanted)).groupBy("run_id").agg(F.collect_set("name").alias("_h"))
    rows = manifests.where("run_id is not null").join(held, "run_id", "left").withColumn("_h", F.coalesce("_h", F.array().cast("array<string>")))
    share = F.size("_h") / F.lit(len(wanted))
    flags = {f"has_{n}": F.array_contains("_h", n) for n in wanted}
    return rows.withColumns(flags | {"artifact_share": share, "stage": F.when(share == 1, "complete").when(share > 0, "partial").otherwise("bare")}).drop("_h")


def claim_registry(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Claims with the run that they rest on: ready if that is complete and the claim has support, blocked otherwise, and what is missing. claims: (claim_key, run_id, support)."""
    rows = claims.join(registry.select("run_id", "stage"), "run_id", "left")
    supported = F.coalesce(_value("support"), F.lit(0.0)) > 0
    complete = F.coalesce(F.col("stage") == "complete", F.lit(False))
    missing = F.concat_ws("|", F.when(F.col("stage").isNull(), "run"), F.when(F.col("stage").isNotNull() & ~complete, "artifacts"), F.when(~supported, "support"))
    return rows.select("claim_key", "run_id", F.when(complete & supported, "ready").otherwise("blocked").alias("status"), missing.alias("missing"))


def leaderboard(history: DataFrame, metric: str, most: int) -> DataFrame:
    """The models with the highest mean of a metric: mean, best and number of runs; blank names and missing values are left out."""
    rows = history.withColumns({"model_name": F.trim("model_name"), "_v": _value(metric)}).where("model_name <> '' and _v is not null")
    found = rows.groupBy("model_name", "model_type").agg(F.avg("_v").alias("mean_metric"), F.max("_v").alias("best_metric"), F.count_distinct("run_id").alias("run_count"))
    return found.orderBy(F.desc("mean_metric"), F.desc("best_metric"), F.desc("run_count"), "model_name", "model_type").limit(most)


def backtest_summary(rows: DataFrame, metric: str = "top1") -> DataFrame:
    """Per model: mean, sample deviation (0 for one row) and count of a metric; blank names and missing values are left out."""
    kept = rows.withColumns({"model_name": F.trim("model_name"), "_v": _value(metric)}).where("model_name <> '' and _v is not null")
    return kept.groupBy("model_name").agg(F.lit(metric).alias("metric_name"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("std"), F.count("_v").alias("count"))


def review_snapshot(snapshot: DataFrame, history: DataFrame, actions: DataFrame) -> DataFrame:
    """The snapshot's row with numbers of review actions by priority, and cadence of the latest row of the history."""
    counts = actions.agg(F.count(F.lit(1)).alias("review_action_count"), share_of("priority", "high").alias("high_priority_actions"), share_of("priority", "medium").alias("medium_priority_actions"))
    cadence = F.struct(F.col("fast_cadence_status").alias("latest_fast_cadence_status"), F.col("full_cadence_status").alias("latest_full_cadence_status"))
    past = history.agg(F.count(F.lit(1)).alias("history_points"), F.max_by(cadence, F.try_to_timestamp("generated_at")).alias("l")).select("history_points", "l.*")
    return snapshot.limit(1).join(F.broadcast(counts)).join(F.broadcast(past))


def review_overview(snapshot: DataFrame, history: DataFrame) -> DataFrame:
    """The review snapshot with span and means of the history."""
    at = F.try_to_timestamp("generated_at")
    past = history.agg(F.min(at).alias("history_window_start"), F.max(at).alias("history_window_end"), *(F.avg(_value(c)).alias(f"mean_{c}") for c in ("target_drift_jsd", "stress_benchmark_skip_risk", "selective_risk")))
    return snapshot.limit(1).join(F.broadcast(past))


def weekly_areas(history: DataFrame, column: str, least: int = 2) -> DataFrame:
    """Areas that a text joined by pipes names in at least so many rows, with their number."""
    area = F.explode(F.array_distinct(F.transform(F.split(column, "\\|"), lambda x: F.trim(x))))
    return history.select(area.alias("area")).where("area <> ''").groupBy("area").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def freshness(rows: DataFrame, branch: str) -> DataFrame:
    """Per branch: rows by source status and how stale it is; the status is the first that holds of missing_source, attention, fresh, source_empty and source_fresh."""
    n = lambda s: share_of("status", s)
    counts = rows.groupBy(branch).agg(F.count(F.lit(1)).alias("sources"), *(n(s).alias(s) for s in ("missing", "stale", "fresh", "empty")), F.max("age_days").alias("oldest_days"))
    status = F.when(F.col("missing") > 0, "missing_source").when(F.col("stale") > 0, "attention").when(F.col("fresh") == F.col("sources"), "fresh").when(F.col("empty") > 0, "source_empty").otherwise("source_fresh")
    return counts.withColumn("freshness_status", status)


def scenes(opportunities: DataFrame) -> DataFrame:
    """Per report family and scene: opportunities by band, mean and best score, and means of the scene's measures."""
    score = _value("opportunity_score")
    total = opportunities.groupBy("report_family_id", "scene_name").agg(
        share_of("opportunity_band", PRIORITY).alias("priority_now_count"),
        share_of("opportunity_band", WATCH).alias("watchlist_count"),
        F.avg(score).alias("avg_opportunity_score"),
        F.max(score).alias("top_opportunity_score"),
        *(F.avg(_value(c)).alias(c) for c in ("scene_local_play_share", "scene_release_pressure")),
    )
    best = best_row(opportunities, ["report_family_id", "scene_name"], {"top_opportunity_artist": F.col("artist_name")}, -score, F.col("opportunity_id"))
    same = (total["report_family_id"].eqNullSafe(best["report_family_id"])) & (total["scene_name"].eqNullSafe(best["scene_name"]))
    return total.join(best, same).select(total["*"], best["top_opportunity_artist"])


def scene_seeds(opportunities: DataFrame) -> DataFrame:
    """Per report family, scene and seed artist named: opportunities and their mean score."""
    seed = F.explode(F.array_distinct(listed(F.col("connected_seed_artists")))).alias("seed_artist")
    rows = opportunities.select("report_family_id", "scene_name", "opportunity_score", seed)
    return rows.groupBy("report_family_id", "scene_name", "seed_artist").agg(F.count(F.lit(1)).alias("opportunity_count"), F.avg(_value("opportunity_score")).alias("avg_opportunity_score"))


def family_summary(families: DataFrame, opportunities: DataFrame, scene_rows: DataFrame, seed_rows: DataFrame) -> DataFrame:
    """A row for every report family: numbers of its rows, its mean score, and its best artist and scene."""
    key, score = ["report_family_id"], _value("opportunity_score")
    ranked = opportunities.groupBy(*key).agg(F.count("artist_name").alias("ranking_rows"), share_of("opportunity_band", PRIORITY).alias("priority_now_count"), F.avg(score).alias("avg_opportunity_score"))
    artist = best_row(opportunities, key, {"top_opportunity_artist": F.col("artist_name")}, -score, F.col("opportunity_id"))
    scene = best_row(scene_rows, key, {"top_scene_name": F.col("scene_name")}, -F.col("avg_opportunity_score"), F.col("scene_name"))
    found = families
    for part in (ranked, artist, scene_rows.groupBy(*key).agg(F.count("scene_name").alias("scene_rows")), scene, seed_rows.groupBy(*key).agg(F.count("seed_artist").alias("scene_seed_rows"))):
        found = found.join(part, key, "left")
    return found


def artist_opportunities(opportunities: DataFrame) -> DataFrame:
    """Per artist: appearances, report families, priorities, mean and best score, and scene and driver of the best row."""
    score = _value("opportunity_score")
    total = opportunities.where("artist_name is not null").groupBy("artist_name").agg(
        F.count(F.lit(1)).alias("appearance_count"), F.count_distinct("report_family_id").alias("family_count"), share_of("opportunity_band", PRIORITY).alias("priority_now_count"), F.avg(score).alias("mean_opportunity_score"), F.max(score).alias("max_opportunity_score")
    )
    best = best_row(opportunities, ["artist_name"], {"top_scene_name": F.col("scene_name"), "top_primary_driver": F.col("primary_driver")}, -score, F.col("opportunity_id"))
    return total.join(best, "artist_name")


def scene_pressure(scene_rows: DataFrame) -> DataFrame:
    """Per scene over the report families: their number, priorities, means and best of the scores, and the artist of the best family."""
    named = scene_rows.where("scene_name is not null")
    total = named.groupBy("scene_name").agg(
        F.count_distinct("report_family_id").alias("family_count"),
        F.sum("priority_now_count").alias("total_priority_now_count"),
        F.avg("avg_opportunity_score").alias("mean_opportunity_score"),
        F.max("top_opportunity_score").alias("max_top_opportunity_score"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("scene_local_play_share", "scene_release_pressure")),
    )
    best = best_row(named, ["scene_name"], {"top_opportunity_artist_example": F.col("top_opportunity_artist")}, -F.col("top_opportunity_score"), F.col("report_family_id"))
    return total.join(best, "scene_name")


def weighted(df: DataFrame, weights: Mapping[str, float], into: str, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Sum of the columns, each brought to 0..1 over the table and weighted; a missing value counts 0."""
    found = scaled(df, {c: c not in lower_is_better for c in weights})
    total = sum((F.coalesce(F.col(f"norm_{c}"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return found.withColumn(into, total).drop(*(f"norm_{c}" for c in weights))


def scene_pulse(scene_rows: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Per scene: families, priorities, means of its measures, its usual driver, the best artist, and a momentum score of five of them."""
    named = scene_rows.where("scene_name is not null")
    total = named.groupBy("scene_name").agg(
        F.count_distinct("report_family_id").alias("family_count"), F.avg("scene_local_play_share").alias("avg_scene_local_play_share"), F.avg("avg_opportunity_score").alias("avg_opportunity_score"), F.sum("priority_now_count").alias("total_priority_now"),
        F.sum("watchlist_count").alias("total_watchlist"), F.avg("scene_release_pressure").alias("avg_release_pressure"),
    )
    rows = opportunities.where("scene_name is not null")
    bridges = rows.groupBy("scene_name").agg(F.avg(F.size(listed(F.col("connected_seed_artists")))).alias("avg_seed_bridge_count"), F.avg(_value("fan_migration_score")).alias("avg_inbound"))
    best = best_row(named, ["scene_name"], {"top_opportunity_artist": F.col("top_opportunity_artist")}, -F.col("top_opportunity_score"), F.col("report_family_id"))
    found = total.join(bridges, "scene_name", "left").join(mode_of(rows, ["scene_name"], "primary_driver", "dominant_driver"), "scene_name", "left").join(best, "scene_name", "left")
    return weighted(found, {"avg_opportunity_score": 0.30, "avg_scene_local_play_share": 0.25, "total_priority_now": 0.20, "avg_inbound": 0.15, "avg_release_pressure": 0.10}, "momentum_score", ["avg_release_pressure"])


def lane_atlas(opportunities: DataFrame) -> DataFrame:
    """Per scene and driver: families, artists, opportunities by band, means, the best artist, and how attractive the lane is."""
    keys, score = ["scene_name", "primary_driver"], _value("opportunity_score")
    rows = opportunities.where("scene_name is not null and primary_driver is not null")
    means = {"opportunity_score": "avg_opportunity_score", "scene_local_play_share": "avg_scene_local_play_share", "scene_release_pressure": "avg_scene_release_pressure", "fan_migration_score": "avg_fan_migration_score", "release_whitespace_score": "avg_release_whitespace_score", "local_gap_score": "avg_local_gap_score", "scene_momentum_score": "avg_scene_momentum_score"}
    total = rows.groupBy(*keys).agg(
        F.count_distinct("report_family_id").alias("family_count"), F.count_distinct("artist_name").alias("artist_count"), F.count("artist_name").alias("opportunity_count"), share_of("opportunity_band", PRIORITY).alias("priority_now_count"), share_of("opportunity_band", WATCH).alias("watchlist_count"),
        F.avg(F.size(listed(F.col("connected_seed_artists")))).alias("avg_seed_bridge_count"), *(F.avg(_value(c)).alias(n) for c, n in means.items()),
    )
    found = total.join(best_row(rows, keys, {"representative_artist": F.col("artist_name")}, -score, F.col("opportunity_id")), keys)
    weights = {"avg_opportunity_score": 0.25, "priority_now_count": 0.20, "avg_scene_local_play_share": 0.15, "avg_fan_migration_score": 0.15, "avg_seed_bridge_count": 0.10, "avg_local_gap_score": 0.10, "avg_release_whitespace_score": 0.05}
    return weighted(found, weights, "lane_attractiveness_score")


def scene_market(pulse: DataFrame, lanes: DataFrame) -> DataFrame:
    """The pulse of every scene with its lanes: how many, their artists, and the most attractive one."""
    total = lanes.groupBy("scene_name").agg(F.count("primary_driver").alias("lane_count"), F.sum("artist_count").alias("artist_count"), F.max("lane_attractiveness_score").alias("lane_attractiveness_score"))
    best = best_row(lanes, ["scene_name"], {"representative_artist": F.col("representative_artist")}, -F.col("lane_attractiveness_score"), F.col("primary_driver"))
    return pulse.join(total, "scene_name", "left").join(best, "scene_name", "left")


def whitespace_atlas(opportunities: DataFrame) -> DataFrame:
    """Per artist and scene with a release gap, a whitespace score or labels: means, the longest gap, usual driver and labels, and a signal score."""
    labels, bridges = listed(F.col("dominant_release_labels")), F.size(listed(F.col("connected_seed_artists")))
    gap = (F.coalesce(_value("release_whitespace_score"), F.lit(0.0)) > 0) | (F.coalesce("days_since_latest_release", F.lit(0)) > 0) | (F.size(labels) > 0)
    rows = opportunities.where(gap & F.col("artist_name").isNotNull() & F.col("scene_name").isNotNull()).withColumn("_labels", F.nullif(F.concat_ws("|", F.slice(labels, 1, 3)), F.lit("")))
    keys = ["artist_name", "scene_name"]
    total = rows.groupBy(*keys).agg(
        F.count_distinct("report_family_id").alias("family_count"), F.avg(_value("opportunity_score")).alias("avg_opportunity_score"), F.avg(_value("release_whitespace_score")).alias("avg_release_whitespace_score"), F.max("days_since_latest_release").alias("max_days_since_latest_release"),
        F.avg(bridges).alias("avg_seed_bridge_count"),
    )
    found = total.join(mode_of(rows, keys, "_labels", "dominant_labels"), keys, "left").join(mode_of(rows, keys, "primary_driver", "primary_driver"), keys, "left")
    return weighted(found, {"avg_release_whitespace_score": 0.45, "avg_opportunity_score": 0.30, "max_days_since_latest_release": 0.15, "avg_seed_bridge_count": 0.10}, "whitespace_signal_score")


def seed_bridges(seed_rows: DataFrame) -> DataFrame:
    """Per scene and seed artist over the report families: families, opportunities, mean score, and a bridge score."""
    rows = seed_rows.where("scene_name is not null")
    total = rows.groupBy("scene_name", "seed_artist").agg(F.count_distinct("report_family_id").alias("family_count"), F.sum("opportunity_count").alias("opportunity_count"), F.avg("avg_opportunity_score").alias("avg_opportunity_score"))
    return weighted(total, {"avg_opportunity_score": 0.6, "opportunity_count": 0.4}, "bridge_score")


def migration_network(edges: DataFrame, family: str) -> DataFrame:
    """Per pair of artists over the families that have a route between them: families, mentions, transitions, mean shares, and a strength score."""
    total = edges.groupBy("source", "target").agg(F.count_distinct(family).alias("family_count"), F.count(F.lit(1)).alias("route_mentions"), F.sum("n").alias("total_transition_count"), F.avg("out_share").alias("avg_source_out_share"), F.avg("in_share").alias("avg_target_in_share"))
    return weighted(total, {"avg_source_out_share": 0.45, "avg_target_in_share": 0.25, "total_transition_count": 0.30}, "route_strength_score")


def rising(rollup: DataFrame, family: str, order: str, keys: Sequence[str], value: str, most: int = 10, high: float = 0.25, medium: float = 0.05) -> DataFrame:
    """What rose from its first to its latest family: first and latest value, the change, its severity and its place among the `most` largest."""
    at = F.struct(F.col(order), F.col(family))
    ends = rollup.groupBy(*keys).agg(F.count_distinct(family).alias("family_count"), F.count(F.lit(1)).alias("repeat_count"), *(f(F.struct(F.col(family).alias("f"), F.coalesce(value, F.lit(0.0)).alias("v")), at).alias(n) for n, f in (("a", F.min_by), ("b", F.max_by))))
    delta = F.col("b.v") - F.col("a.v")
    rows = ends.where((F.col("family_count") >= 2) & (delta > 0)).select(*keys, "family_count", "repeat_count", F.col("a.f").alias("first_family"), F.col("b.f").alias("latest_family"), F.col("a.v").alias("first_value"), F.col("b.v").alias("latest_value"), delta.alias("delta_value"))
    rows = rows.withColumn("severity", F.when(F.col("delta_value") >= high, "high").when(F.col("delta_value") >= medium, "medium").otherwise("low"))
    top = rows.orderBy(F.desc("delta_value"), *keys).limit(most)
    order_ = F.struct((-F.col("delta_value")).alias("d"), *keys)
    ranks = top.agg(F.array_sort(F.collect_list(order_)).alias("all"))
    return top.join(F.broadcast(ranks)).withColumn("category_rank", F.array_position("all", order_)).drop("all")

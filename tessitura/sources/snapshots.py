"""Tables of runs, histories, reviews and reports from the documents and CSV files that hold them."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.scalars import number, text_or_null, truth
from tessitura.sources import files
from tessitura.sources.artifacts import read_csv

# Columns of run manifests. Plain fields; fields of nested objects, which come as <object>_<field>; fields and
# objects that come as JSON text, as <name>_json.
MANIFEST = (
    "run_id run_name profile timestamp run_dir data_records num_artists num_context_features enable_mlflow enable_optuna enable_retrieval_stack enable_self_supervised_pretraining enable_friction_analysis enable_moonshot_lab enable_temporal_backtest "
    "temporal_backtest_folds temporal_backtest_adaptation_mode retrieval_candidate_k optuna_trials optuna_rows backtest_rows"
)
NESTED = {
    "champion_gate": "status promoted metric_source threshold regression champion_run_id champion_model_name champion_score challenger_model_name challenger_score",
    "champion_alias": "model_name model_type updated",
    "cache": "enabled hit fingerprint source_file_count",
    "artifact_cleanup": "status mode freed_bytes selected_model_name",
    "artifact_retention": "keep_last_full_runs",
}
AS_JSON = "deep_models classical_models optuna_models temporal_backtest_models champion_gate champion_alias cache artifact_cleanup artifact_retention mlflow_artifact_cleanup"
# Columns of history files; the time comes first.
HISTORIES = {
    "experiment": "run_id run_name profile model_name model_type model_family val_top1:d val_top5:d test_top1:d test_top5:d fit_seconds:d epochs:d data_records:d",
    "backtest": "run_id run_name profile model_name model_family fold:l train_rows:l test_rows:l fit_seconds:d top1:d top5:d",
    "optuna": "run_id run_name profile model_name base_model_name n_trials:l val_top1:d test_top1:d fit_seconds:d best_params_json",
    "benchmark": "benchmark_id model_name model_type model_family runs:l val_top1_mean:d val_top1_std:d val_top1_ci95:d test_top1_mean:d test_top1_std:d test_top1_ci95:d",
}
# Columns of the review snapshot, by where the document holds them.
REVIEW = {
    "generated_at": "generated_at", "selected_run_reason": "run_selection.selection_reason", "latest_run_id": "latest_run.run_id", "latest_run_profile": "latest_run.profile", "latest_run_best_model_name": "latest_run.best_model_name", "latest_run_best_model_type": "latest_run.best_model_type", "latest_run_best_model_test_top1": "latest_run.best_model_test_top1",
    "latest_run_serving_model_name": "latest_run.serving_model_name", "latest_run_serving_model_type": "latest_run.serving_model_type", "latest_run_promoted": "latest_run.promoted", "ops_health_status": "ops_health.status", "ops_health_headline": "ops_health.headline", "operating_rhythm_status": "operating_rhythm.overall_status",
    "operating_rhythm_recommended_run_command": "operating_rhythm.recommended_run_command", "operating_rhythm_recommended_run_reason": "operating_rhythm.recommended_run_reason", "target_drift_jsd": "safety.test_jsd_target_drift", "selective_risk": "safety.test_selective_risk", "abstention_rate": "safety.test_abstention_rate",
    "accepted_rate": "safety.test_accepted_rate", "repeat_from_prev_new_gap": "safety.repeat_from_prev_new_gap", "stress_benchmark_skip_risk": "qoe.stress_benchmark_skip_risk", "stress_benchmark_scenario": "qoe.stress_benchmark_scenario", "stress_benchmark_policy_name": "qoe.stress_benchmark_policy_name",
}
NUMBERS = "latest_run_best_model_test_top1 target_drift_jsd selective_risk abstention_rate accepted_rate repeat_from_prev_new_gap stress_benchmark_skip_risk"
# Snapshot tables of reports by file, with their columns.
FRAMES = {
    "scene_market_pulse.csv": "scene_name family_count:l avg_scene_local_play_share:d avg_opportunity_score:d total_priority_now:l total_watchlist:l avg_release_pressure:d avg_label_concentration:d avg_inbound_target_share:d avg_outbound_source_share:d avg_seed_bridge_count:d dominant_driver top_opportunity_artist top_migration_route strategy_posture momentum_score:d",
    "opportunity_lane_atlas.csv": "scene_name primary_driver family_count:l artist_count:l opportunity_count:l priority_now_count:l watchlist_count:l avg_opportunity_score:d avg_scene_local_play_share:d avg_scene_release_pressure:d avg_scene_label_concentration:d avg_seed_bridge_count:d avg_fan_migration_score:d avg_release_whitespace_score:d avg_local_gap_score:d avg_scene_momentum_score:d representative_artist lane_posture lane_attractiveness_score:d",
    "market_migration_network.csv": "source_artist target_artist family_count:l route_mentions:l total_transition_count:l avg_source_out_share:d avg_target_in_share:d source_scene_name target_scene_name route_strength_score:d",
    "seed_scene_bridge_atlas.csv": "scene_name seed_artist family_count:l opportunity_count:l avg_opportunity_score:d avg_bridge_artist_count:d avg_scene_local_play_share:d avg_scene_release_pressure:d avg_scene_label_concentration:d top_opportunity_artist dominant_driver bridge_score:d",
    "release_whitespace_atlas.csv": "artist_name scene_name family_count:l avg_opportunity_score:d avg_release_whitespace_score:d max_days_since_latest_release:d avg_seed_bridge_count:d dominant_labels primary_driver whitespace_signal_score:d",
}
_KINDS = {"d": T.DoubleType(), "l": T.LongType(), "": T.StringType()}


def declared(columns: str) -> T.StructType:
    """A schema from names with :d for doubles and :l for whole numbers; others are text."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, _, k in (c.partition(":") for c in columns.split())])


def read_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text) of JSON documents, one a file; broken ones are left out. None match: no rows."""
    parent = pattern.split("*", 1)[0].rsplit("/", 1)[0]
    if not files.exists(spark, parent):
        return spark.createDataFrame([], "path string, text string")
    rows = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.where(F.try_parse_json("text").isNotNull() & F.json_object_keys("text").isNotNull())


def _at(path: str) -> Column:
    return F.get_json_object("text", f"$.{path}")


def run_manifests(documents: DataFrame) -> DataFrame:
    """One row per manifest: its fields, those of nested objects, the lists and objects as JSON, the time as timestamp and the whole as raw_json."""
    plain = [_at(c).alias("run_timestamp" if c == "timestamp" else c) for c in MANIFEST.split()]
    nested = [_at(f"{o}.{c}").alias(f"{o}_{c}") for o, cs in NESTED.items() for c in cs.split()]
    rows = documents.select("path", *plain, *nested, *(_at(c).alias(f"{c}_json") for c in AS_JSON.split()), F.col("text").alias("raw_json"))
    whole = "data_records num_artists num_context_features temporal_backtest_folds retrieval_candidate_k optuna_trials optuna_rows backtest_rows cache_source_file_count artifact_cleanup_freed_bytes artifact_retention_keep_last_full_runs"
    flags = [c for c in rows.columns if c.startswith("enable_")] + ["champion_gate_promoted", "champion_alias_updated", "cache_enabled", "cache_hit"]
    reals = ["champion_gate_threshold", "champion_gate_regression", "champion_gate_champion_score", "champion_gate_challenger_score"]
    typed = {c: number(F.col(c)).cast("long") for c in whole.split()} | {c: truth(F.col(c)) for c in flags} | {c: number(F.col(c)) for c in reals}
    return rows.withColumns(typed | {"run_timestamp": F.try_to_timestamp("run_timestamp")}).drop("path")


def read_history_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A history CSV with the columns of its kind, the time as event_timestamp; a missing file gives no rows."""
    rows = read_csv(spark, path, T.StructType([T.StructField("timestamp", T.TimestampType()), *declared(HISTORIES[kind]).fields]))
    return rows.withColumnRenamed("timestamp", "event_timestamp")


def review_snapshot(documents: DataFrame) -> DataFrame:
    """One row per review document: the columns of REVIEW, the run selected, and how many actions and next bets it has."""
    made = {c: _at(p) for c, p in REVIEW.items()}
    made |= {c: number(made[c]) for c in NUMBERS.split()} | {"latest_run_promoted": truth(made["latest_run_promoted"]), "selected_run_id": selected_run()}
    n = lambda p: F.coalesce(F.json_array_length(_at(p)), F.lit(0)).cast("long")
    return documents.select(*(v.alias(c) for c, v in made.items()), n("review_actions").alias("review_action_count"), n("next_bets").alias("next_bet_count"), F.col("text").alias("raw_json"))


def selected_run() -> Column:
    """The selected run's id, given by itself or in an object."""
    return F.coalesce(_at("run_selection.selected_run.run_id"), F.when(~F.coalesce(_at("run_selection.selected_run"), F.lit("")).startswith("{"), _at("run_selection.selected_run")))


def review_actions(documents: DataFrame) -> DataFrame:
    """One row per review action, in order from 1, what to inspect joined by pipes."""
    actions = F.posexplode(F.from_json(_at("review_actions"), "array<struct<priority:string,area:string,title:string,detail:string,inspect:array<string>>>"))
    rows = documents.select(_at("generated_at").alias("generated_at"), selected_run().alias("selected_run_id"), actions.alias("_i", "_a"))
    targets = F.array_join(F.filter(F.transform("_a.inspect", lambda x: F.trim(x)), lambda x: x != ""), "|")
    return rows.where("_a is not null").select("generated_at", "selected_run_id", (F.col("_i") + 1).alias("action_order"), "_a.priority", "_a.area", "_a.title", "_a.detail", targets.alias("inspect_targets"), F.to_json("_a").alias("raw_json"))


def report_families(documents: DataFrame, suffix: str = "_report_family", prefix: str = "creator_label_intelligence_") -> DataFrame:
    """One row per report family, named by its manifest file: its paths, and its seed group, which is its name without the prefix."""
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)[.]json$", 1), f"{suffix}$", "")
    paths = {"primary_report_path": "primary_report", "artifact_index_path": "artifact_index_markdown", "backfilled_artifact_index_at": "backfilled_artifact_index_at"}
    paths |= {f"{n}_{k}_path": f"comparison_view_{k if k == 'csv' else 'markdown'}.{n}_comparison" for n in ("ranking", "scene", "scene_seed", "seed") for k in ("markdown", "csv")}
    return documents.select(name.alias("report_family_id"), F.regexp_replace(name, f"^{prefix}", "").alias("seed_group_slug"), *(_at(p).alias(c) for c, p in paths.items()))


def family_tables(spark: SparkSession, root: str, families: Sequence[str], view: str, columns: str, prefix: str = "creator_label_intelligence_") -> DataFrame:
    """The same comparison CSV of all families in one table, their ids in front; a family without the file gives no rows."""
    found = spark.createDataFrame([], T.StructType([*declared("report_family_id seed_group_slug").fields, *declared(columns).fields]))
    for family in families:
        part = read_csv(spark, posixpath.join(root, f"{family}_{view}_comparison.csv"), declared(columns))
        found = found.unionByName(part.select(F.lit(family).alias("report_family_id"), F.lit(family.removeprefix(prefix)).alias("seed_group_slug"), *part.columns))
    return found


def read_frames(spark: SparkSession, root: str, frames: Mapping[str, str] = FRAMES) -> dict[str, DataFrame]:
    """Snapshot tables by name of their file without its ending; one that is missing has no rows."""
    return {name.rsplit(".", 1)[0]: read_csv(spark, posixpath.join(root, name), declared(columns)) for name, columns in frames.items()}


def branch_health(scores: DataFrame, queue: DataFrame, cards: DataFrame, key: str = "branch_key") -> DataFrame:
    """Every branch's scores with the first of its queue and the first of its cards; those that are no number are null."""
    measures = [c for c in scores.columns if c.endswith("_score") or c == "artifact_count"]
    named = {"rank": "queue_rank", "initiative": "next_initiative", "command": "next_command"}
    first = queue.groupBy(key).agg(F.min_by(F.struct(*[c for c in queue.columns if c != key]), F.struct(number(F.col("rank")).isNull(), number(F.col("rank")), F.col("initiative"))).alias("_q")).select(key, "_q.*").withColumnsRenamed(named)
    card = cards.groupBy(key).agg(F.min(F.struct(*[c for c in cards.columns if c != key])).alias("_c")).select(key, "_c.*")
    return scores.withColumns({c: number(F.col(c)) for c in measures}).join(first, key, "left").join(card, key, "left")


def platform_status(runs: DataFrame, benchmarks: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: the latest run (of equals the last by id), claims ready and blocked, those blocked although their signal is live or for want of a benchmark, benchmarks ready, and the strongest one."""
    latest = runs.agg(F.max_by(F.struct(F.col("run_id").alias("anchor_run_id"), F.col("profile").alias("anchor_profile")), F.struct(F.try_to_timestamp("timestamp"), "run_id")).alias("l")).select("l.*")
    blocked, ready = F.coalesce(truth(F.col("blocked")), F.lit(False)), F.coalesce(truth(F.col("benchmark_comparison_ready")), F.lit(False))
    live = F.lower(text_or_null(F.col("live_signal_status"))).isin("ready", "live", "pass", "supported")
    told = claims.agg(
        F.count(F.lit(1)).alias("claim_total_count"), F.count_if(blocked).alias("claim_blocked_count"), F.count_if(F.lower("claim_readiness_status").isin("ready", "pass")).alias("claim_ready_count"), F.count_if(blocked & live).alias("blocked_live_signal_count"), F.count_if(blocked & ~ready).alias("blocked_benchmark_gap_count")
    )
    strength = number(F.col("benchmark_strength_score"))
    best = F.min_by(F.struct(F.col("benchmark_id").alias("strongest_benchmark_id"), strength.alias("strongest_benchmark_score")), F.struct(strength.isNull(), -strength, F.col("benchmark_id"))).alias("b")
    bench = benchmarks.agg(F.count_if(F.coalesce(truth(F.col("comparison_ready")), F.lit(False))).alias("comparison_ready_benchmark_count"), best).select("comparison_ready_benchmark_count", "b.*")
    return latest.join(told).join(bench)

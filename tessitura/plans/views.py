"""Views over the tables of runs and marts; each is made only if the tables have the columns it reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.scalars import number, truth

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class View:
    """needs: columns by table, the first of which is the one the view is about."""

    name: str
    needs: Mapping[str, str]
    build: Callable[[Tables], DataFrame]

    def possible(self, tables: Tables) -> bool:
        return all(t in tables and set(c.split()) <= set(tables[t].columns) for t, c in self.needs.items())


def _first(*columns: str) -> list[Column]:
    """An order: "-" before a column is largest first; missing values come last."""
    return [F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in columns]


def _means(name: str, table: str, by: str, means: Mapping[str, str], count: str, order: str, more: Mapping[str, Callable[[Column], Column]] | None = None, needs: str = "") -> View:
    """A view of means by group. means: its columns by those they are taken of; more: others, as "column of": aggregate."""

    def build(tables: Tables) -> DataFrame:
        columns = [F.avg(number(F.col(of))).alias(into) for of, into in means.items()]
        columns += [f(number(F.col(key.split()[1]))).alias(key.split()[0]) for key, f in (more or {}).items()]
        return tables[table].groupBy(*by.split()).agg(*columns, F.count(F.lit(1)).alias(count)).orderBy(*_first(*order.split()))

    return View(name, {table: f"{by} {' '.join(means)} {needs}"}, build)


def _rows(name: str, table: str, needs: str, order: str = "", where: Callable[[], Column] | None = None) -> View:
    """A view of whole rows, some of them, in an order."""

    def build(tables: Tables) -> DataFrame:
        df = tables[table] if where is None else tables[table].where(where())
        return df.orderBy(*_first(*order.split())) if order else df

    return View(name, {table: needs}, build)


def _latest_results(tables: Tables) -> DataFrame:
    latest = tables["run_manifests"].select("run_id", "run_timestamp").orderBy(*_first("-run_timestamp", "-run_id")).limit(1)
    return tables["run_results"].join(F.broadcast(latest.select("run_id")), "run_id", "left_semi")


def _champions(tables: Tables) -> DataFrame:
    df = tables["run_manifests"].withColumn("promoted", truth(F.col("champion_gate_promoted"))).where("promoted")
    renamed = {"champion_gate_metric_source": "metric_source", "champion_alias_model_name": "alias_model_name", "champion_alias_model_type": "alias_model_type"}
    return df.withColumnsRenamed(renamed).select("run_id", "profile", "run_timestamp", "promoted", *renamed.values())


# Columns of the view of moonshot runs, by type.
MOONSHOT = {
    "int": "multimodal_embedding_dim multimodal_feature_count safe_policy_bucket_count",
    "boolean": "multimodal_retrieval_fusion_enabled",
    "double": "digital_twin_test_auc causal_test_auc_total journey_mean_horizon stress_worst_skip_risk",
    "string": "stress_worst_skip_scenario",
}


def _moonshots(tables: Tables) -> DataFrame:
    """Joined from the left to the profile of the run; a column that the table lacks is null."""
    df = tables["moonshot_summary"]
    read = lambda c, kind: (truth(F.col(c)) if kind == "boolean" else F.col(c).try_cast(kind)) if c in df.columns else F.lit(None).cast(kind)
    rows = df.select("run_id", *(read(c, kind).alias(c) for kind, names in MOONSHOT.items() for c in names.split()))
    return rows.join(tables["run_manifests"].select("run_id", "profile"), "run_id", "left").orderBy(*_first("-digital_twin_test_auc", "-causal_test_auc_total"))


_over_zero = lambda c: F.coalesce(number(F.col(c)), F.lit(0.0)) > 0
_is_set = lambda c: F.coalesce(truth(F.col(c)), F.lit(False))
_BACKTESTS = {"top1": "mean_backtest_top1"}, "folds", "profile -mean_backtest_top1", {"std_backtest_top1 top1": F.stddev_samp}

#: The views, by name; of two with one name the first that is possible is made.
VIEWS: list[View] = [
    View("latest_run_results", {"run_results": "run_id", "run_manifests": "run_id run_timestamp"}, _latest_results),
    _means("best_models_by_profile", "experiment_history", "profile model_name model_type", {"val_top1": "mean_val_top1", "test_top1": "mean_test_top1"}, "runs", "profile -mean_val_top1"),
    _means("backtest_model_summary", "backtest_history", "profile model_name model_type", *_BACKTESTS),
    _means("backtest_model_summary", "backtest_history", "profile model_name", *_BACKTESTS),
    View("champion_runs", {"run_manifests": "run_id profile run_timestamp champion_gate_promoted champion_gate_metric_source champion_alias_model_name champion_alias_model_type"}, _champions),
    _means("robustness_model_summary", "robustness_summary", "model_name", {"max_top1_gap": "mean_max_top1_gap"}, "runs", "-mean_max_top1_gap", {"worst_observed_gap max_top1_gap": F.max}, "worst_segment worst_bucket run_id"),
    _means("policy_model_summary", "policy_summary", "model_name model_type", {"test_discounted_reward": "mean_test_discounted_reward", "test_hit_at_k": "mean_test_hit_at_k"}, "runs", "-mean_test_discounted_reward", None, "run_id"),
    _means("benchmark_model_summary", "benchmark_history", "benchmark_id model_name", {"val_top1_mean": "mean_val_top1", "test_top1_mean": "mean_test_top1"}, "rows", "benchmark_id -mean_val_top1"),
    View("moonshot_run_summary", {"moonshot_summary": "run_id multimodal_embedding_dim digital_twin_test_auc causal_test_auc_total stress_worst_skip_scenario stress_worst_skip_risk", "run_manifests": "run_id profile"}, _moonshots),
    _rows("latest_ops_overview", "mart_ops_overview", "latest_run_id ops_health_status operating_rhythm_status"),
    _rows("creator_priority_now", "mart_creator_opportunities", "artist_name priority_now_count max_opportunity_score", "-max_opportunity_score -priority_now_count", lambda: _over_zero("priority_now_count")),
    _rows("creator_market_priority_now", "mart_creator_market_watchlist", "artist_name scene_name scene_priority_now_count market_priority_score avg_opportunity_score", "-market_priority_score -avg_opportunity_score -scene_priority_now_count artist_name", lambda: _over_zero("scene_priority_now_count") | _over_zero("market_priority_score")),
    _rows("latest_research_platform_status", "mart_research_platform_status", "anchor_run_id anchor_profile anchor_research_stage status_posture submission_status ready_for_external_review"),
    _rows("research_platform_blocked_claims", "mart_research_claim_watchlist", "claim_key blocked watchlist_score missing_check_count", "-watchlist_score -missing_check_count claim_key", lambda: _is_set("blocked")),
    _rows("scope_expansion_priority_queue", "mart_scope_expansion_health", "branch_key branch_posture queue_rank risk_reduction_score risk_score next_command", "queue_rank -risk_reduction_score -risk_score branch_key"),
    _rows("public_listening_daily_trend", "mart_public_listening_daily_similarity", "listening_date dimension closer_scope global_similarity united_states_similarity", "listening_date dimension"),
    _rows("public_listening_similarity_anomalies", "mart_public_listening_trends", "listening_date dimension similarity_anomaly_flag", "-listening_date dimension", lambda: _is_set("similarity_anomaly_flag")),
]


def register_views(spark: SparkSession, tables: Tables) -> list[str]:
    """Temporary views of the tables and of every view that they allow; the names of the latter. A table without columns is registered as one with `_empty` and no rows."""
    for name, df in tables.items():
        (df if df.columns else spark.createDataFrame([], "_empty string")).createOrReplaceTempView(name)
    made: list[str] = []
    for view in VIEWS:
        if view.name not in made and view.possible(tables):
            view.build(tables).createOrReplaceTempView(view.name)
            made.append(view.name)
    return made

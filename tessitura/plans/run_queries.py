"""Queries of the marts of runs and report families. Manifests, results and backtests are read from the star schema:
customers as runs, orders as results of runs, lines as folds of backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.scalars import LISTED_SQL
from tessitura.operators import runs
from tessitura.plans.views import register_views
from tessitura.tables import table


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(
        F.concat(F.lit("run-"), "c_custkey").alias("run_id"), F.col("c_name").alias("run_name"), F.col("c_mktsegment").alias("profile"), F.expr("case when c_custkey % 7 > 0 then cast(date_add(date'2024-01-01', cast(c_custkey % 900 as int)) as string) end").alias("run_timestamp"), (F.col("c_custkey") * 10).alias("data_records"),
        F.expr("case when c_acctbal > 5000 then 'true' else 'no' end").alias("champion_gate_promoted"), F.expr("case when c_acctbal > 0 then 'pass' else 'fail' end").alias("champion_gate_status"), F.lit("backtest").alias("champion_gate_metric_source"),
        F.expr("concat('m', c_custkey % 5)").alias("champion_alias_model_name"), F.expr("concat('t', c_nationkey % 2)").alias("champion_alias_model_type"),
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.selectExpr(
        "concat('run-', o_custkey) run_id", "concat('m', o_orderkey % 5) model_name", "concat('t', o_orderkey % 2) model_type", "o_orderstatus model_family", "case when o_orderkey % 11 > 0 then (o_orderkey * 37 % 1009) / 1000D end val_top1", "(o_orderkey * 53 % 997) / 1000D test_top1", "o_totalprice fit_seconds", "cast(o_orderkey % 20 as long) epochs"
    )


def backtests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr("concat('run-', l_suppkey) run_id", "concat('m', l_linenumber % 5) model_name", "concat('t', l_linenumber % 2) model_type", "l_returnflag profile", "cast(l_linenumber as long) fold", "l_discount * 10 top1")


def opportunities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "creator_ranking_opportunities").drop("generated_at").distinct()


def _rounded(df: DataFrame, digits: int = 10) -> DataFrame:
    """Doubles rounded, -0 as 0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_summary(manifests(spark, folder), results(spark, folder), backtests(spark, folder))


def a5_run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_summary(spark, folder).drop("run_name", "champion_gate_metric_source", "fit_seconds"))


def a11_run_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(runs.run_quality(_summary(spark, folder)))


def a12_model_registry(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.model_registry(_summary(spark, folder))
    return _rounded(found.withColumn("mean_fit_seconds", F.round("mean_fit_seconds", 3)))


def a38_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(runs.leaderboard(results(spark, folder), "val_top1", 8))


def a51_backtest_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(runs.backtest_summary(backtests(spark, folder)))


WANTED = ["m0", "m1", "m2", "m3"]


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with the models of their results as artifacts."""
    return runs.run_registry(manifests(spark, folder).select("run_id", "profile"), results(spark, folder).select("run_id", F.col("model_name").alias("name")), WANTED)


def a53_run_registry(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_registry(spark, folder))


def a53_claim_registry(spark: SparkSession, folder: str) -> DataFrame:
    claims = table(spark, folder, "supplier").selectExpr("s_name claim_key", "case when s_suppkey % 10 = 0 then 'run-none' else concat('run-', s_suppkey * 3) end run_id", "case when s_acctbal > 1000 then '2' when s_acctbal > 0 then 'n/a' end support")
    return runs.claim_registry(claims, _registry(spark, folder))


def _review(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A snapshot, a history and review actions: of the nations the first, the suppliers and the parts."""
    snapshot = table(spark, folder, "nation").where("n_nationkey = 0").select(F.col("n_name").alias("selected_run_id"), F.lit("healthy").alias("ops_health_status"))
    history = table(spark, folder, "supplier").selectExpr(
        "case when s_suppkey % 9 > 0 then cast(date_add(date'2024-01-01', cast(s_suppkey as int)) as string) else 'unknown' end generated_at", "concat('fast-', s_suppkey % 3) fast_cadence_status", "concat('full-', s_suppkey % 4) full_cadence_status", "cast(s_acctbal / 10000 as string) target_drift_jsd", "case when s_nationkey > 3 then 'n/a' else cast(s_nationkey as string) end stress_benchmark_skip_risk", "s_acctbal selective_risk"
    )
    actions = table(spark, folder, "part").selectExpr("case when p_size < 10 then 'high' when p_size < 30 then 'medium' else 'low' end priority", "p_type area")
    return snapshot, history, actions


def a6_review_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return runs.review_snapshot(*_review(spark, folder))


def a13_review_overview(spark: SparkSession, folder: str) -> DataFrame:
    snapshot, history, actions = _review(spark, folder)
    found = runs.review_overview(runs.review_snapshot(snapshot, history, actions), history)
    return _rounded(found.withColumns({c: F.col(c).cast("date").cast("string") for c in ("history_window_start", "history_window_end")}))


def a39_weekly_areas(spark: SparkSession, folder: str) -> DataFrame:
    """Areas that several rows name, from families of parts joined by pipes."""
    areas = table(spark, folder, "part").select(F.concat_ws("|", "p_brand", "p_type", F.lit(" "), "p_brand").alias("areas"))
    return runs.weekly_areas(areas, "areas", 5)


def a44_freshness(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").selectExpr("c_nationkey branch", "case when c_custkey % 53 = 0 then 'missing' when c_acctbal < -900 then 'stale' when c_custkey % 17 = 0 then 'empty' else 'fresh' end status", "cast(c_custkey % 365 as long) age_days")
    return runs.freshness(rows, "branch")


def _families(spark: SparkSession, folder: str) -> DataFrame:
    return opportunities(spark, folder).where("report_family_id is not null").groupBy("report_family_id").agg(F.min("seed_group_slug").alias("seed_group_slug"))


def a7_family_summary(spark: SparkSession, folder: str) -> DataFrame:
    o = opportunities(spark, folder)
    return _rounded(runs.family_summary(_families(spark, folder), o, runs.scenes(o), runs.scene_seeds(o)))


def a8_scene_market(spark: SparkSession, folder: str) -> DataFrame:
    o = opportunities(spark, folder)
    return _rounded(runs.scene_market(runs.scene_pulse(runs.scenes(o), o), runs.lane_atlas(o)))


def a14_artist_opportunities(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(runs.artist_opportunities(opportunities(spark, folder)))


def a15_scene_pressure(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(runs.scene_pressure(runs.scenes(opportunities(spark, folder))))


def a35_lane_atlas(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(runs.lane_atlas(opportunities(spark, folder)))


def a35_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(runs.whitespace_atlas(opportunities(spark, folder)))


def a35_seed_bridges(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(runs.seed_bridges(runs.scene_seeds(opportunities(spark, folder))))


def a37_rising_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes whose signal rose from the first report family to the latest, in order of the families' ids."""
    s = runs.scenes(opportunities(spark, folder)).where("report_family_id is not null and scene_name is not null")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    signal = F.round(zero("avg_opportunity_score") + zero("scene_local_play_share") + 0.05 * F.col("priority_now_count") + 0.02 * F.col("watchlist_count") + 0.10 * zero("scene_release_pressure"), 9)
    return _rounded(runs.rising(s.withColumn("signal", signal).withColumn("at", F.col("report_family_id")), "report_family_id", "at", ["scene_name"], "signal"))


def _view(name: str, *tables: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        made = {"run_manifests": lambda: manifests(spark, folder), "run_results": lambda: results(spark, folder), "backtest_history": lambda: backtests(spark, folder), "experiment_history": lambda: results(spark, folder).join(manifests(spark, folder).select("run_id", "profile"), "run_id")}
        register_views(spark, {t: made[t]() for t in tables})
        return _rounded(spark.table(name))

    query.__doc__ = f"The view {name}."
    return query


QUERIES = {
    f.__name__: f
    for f in (
        a5_run_summary, a6_review_snapshot, a7_family_summary, a8_scene_market, a11_run_quality, a12_model_registry, a13_review_overview, a14_artist_opportunities, a15_scene_pressure, a35_lane_atlas, a35_whitespace, a35_seed_bridges, a37_rising_scenes, a38_leaderboard, a39_weekly_areas, a44_freshness, a51_backtest_summary, a53_run_registry, a53_claim_registry,
    )
} | {
    "a20_latest_run_results": _view("latest_run_results", "run_manifests", "run_results"),
    "a20_best_models": _view("best_models_by_profile", "experiment_history"),
    "a20_backtests": _view("backtest_model_summary", "backtest_history"),
    "a20_champions": _view("champion_runs", "run_manifests"),
}

_R = """WITH m AS (SELECT 'run-' || c_custkey AS run_id, c_name AS run_name, c_mktsegment AS profile, CASE WHEN c_custkey % 7 > 0 THEN CAST(CAST(date '2024-01-01' + CAST(c_custkey % 900 AS INTEGER) AS DATE) AS VARCHAR) END AS run_timestamp, c_custkey * 10 AS data_records,
  CASE WHEN c_acctbal > 5000 THEN 'true' ELSE 'no' END AS promoted, CASE WHEN c_acctbal > 0 THEN 'pass' ELSE 'fail' END AS champion_gate_status, 'backtest' AS champion_gate_metric_source, 'm' || c_custkey % 5 AS champion_alias_model_name, 't' || c_nationkey % 2 AS champion_alias_model_type FROM customer),
r AS (SELECT 'run-' || o_custkey AS run_id, 'm' || o_orderkey % 5 AS model_name, 't' || o_orderkey % 2 AS model_type, o_orderstatus AS model_family, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey * 37 % 1009) / 1000.0::DOUBLE END AS val_top1, (o_orderkey * 53 % 997) / 1000.0::DOUBLE AS test_top1, o_totalprice AS fit_seconds, o_orderkey % 20 AS epochs FROM orders),
b AS (SELECT 'run-' || l_suppkey AS run_id, 'm' || l_linenumber % 5 AS model_name, 't' || l_linenumber % 2 AS model_type, l_returnflag AS profile, l_linenumber AS fold, l_discount * 10 AS top1 FROM lineitem),
f AS (SELECT run_id, model_name, avg(top1) AS mean_backtest_top1, count(top1) AS backtest_folds FROM b GROUP BY ALL),
s AS (SELECT r.*, m.* EXCLUDE (run_id), mean_backtest_top1, backtest_folds, CASE WHEN val_top1 IS NOT NULL THEN dense_rank() OVER (PARTITION BY r.run_id ORDER BY val_top1 DESC NULLS LAST) END AS val_rank_within_run,
  dense_rank() OVER (PARTITION BY r.run_id ORDER BY test_top1 DESC) AS test_rank_within_run, coalesce(r.model_name = champion_alias_model_name, false) AS is_serving_alias FROM r LEFT JOIN m USING (run_id) LEFT JOIN f ON f.run_id = r.run_id AND f.model_name = r.model_name)
"""
_REGISTRY = (
    _R
    + ", a AS (SELECT run_id, "
    + ", ".join(f"max((model_name = '{w}')::INT) AS h{i}" for i, w in enumerate(WANTED))
    + " FROM r GROUP BY 1), g AS (SELECT m.run_id, profile, "
    + ", ".join(f"coalesce(h{i}, 0) = 1 AS has_{w}" for i, w in enumerate(WANTED))
    + ", coalesce(h0 + h1 + h2 + h3, 0) / 4.0::DOUBLE AS artifact_share, CASE coalesce(h0 + h1 + h2 + h3, 0) WHEN 4 THEN 'complete' WHEN 0 THEN 'bare' ELSE 'partial' END AS stage FROM m LEFT JOIN a ON a.run_id = m.run_id) "
)
_H = """WITH h AS (SELECT CASE WHEN s_suppkey % 9 > 0 THEN CAST(date '2024-01-01' + CAST(s_suppkey AS INTEGER) AS DATE) END AS day_, 'fast-' || s_suppkey % 3 AS fast, 'full-' || s_suppkey % 4 AS full_, s_acctbal, s_nationkey FROM supplier),
a AS (SELECT count(*) AS review_action_count, count(*) FILTER (p_size < 10) AS high_priority_actions, count(*) FILTER (p_size >= 10 AND p_size < 30) AS medium_priority_actions FROM part),
p AS (SELECT count(*) AS history_points, arg_max(fast, day_) AS latest_fast_cadence_status, arg_max(full_, day_) AS latest_full_cadence_status FROM h),
s AS (SELECT n_name AS selected_run_id, 'healthy' AS ops_health_status, a.*, p.* FROM nation, a, p WHERE n_nationkey = 0)
"""


def _clean(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


_LIST = LISTED_SQL
_SCORES = ("opportunity_score", "scene_local_play_share", "scene_release_pressure", "fan_migration_score", "release_whitespace_score", "local_gap_score", "scene_momentum_score")
_O = f"""WITH o AS (SELECT DISTINCT * EXCLUDE (generated_at) REPLACE ({", ".join(f"{_clean(c)} AS {c}" for c in _SCORES)}) FROM creator_ranking_opportunities),
c AS (SELECT report_family_id, scene_name, count(*) FILTER (opportunity_band = 'priority_now') AS priority_now_count, count(*) FILTER (opportunity_band = 'watchlist') AS watchlist_count, avg(opportunity_score) AS avg_opportunity_score, max(opportunity_score) AS top_opportunity_score,
  avg(scene_local_play_share) AS scene_local_play_share, avg(scene_release_pressure) AS scene_release_pressure FROM o GROUP BY ALL),
t AS (SELECT report_family_id, scene_name, artist_name AS top_opportunity_artist FROM o QUALIFY row_number() OVER (PARTITION BY report_family_id, scene_name ORDER BY opportunity_score DESC NULLS LAST, opportunity_id) = 1),
sc AS (SELECT c.*, top_opportunity_artist FROM c JOIN t ON c.report_family_id IS NOT DISTINCT FROM t.report_family_id AND c.scene_name IS NOT DISTINCT FROM t.scene_name),
sd AS (SELECT report_family_id, scene_name, seed_artist, count(*) AS opportunity_count, avg(opportunity_score) AS avg_opportunity_score FROM (SELECT report_family_id, scene_name, opportunity_score, unnest(list_distinct({_LIST.format('connected_seed_artists')})) AS seed_artist FROM o) GROUP BY ALL)
"""


def _part(c: str, up: bool = True) -> str:
    x = f"({c} - min({c}) OVER ()) / nullif((max({c}) OVER () - min({c}) OVER ())::DOUBLE, 0)"
    return f"coalesce(CASE WHEN {c} IS NOT NULL THEN coalesce({x if up else f'1 - {x}'}, 0.5) END, 0)"


def _weighted(weights: dict[str, float], lower: tuple[str, ...] = ()) -> str:
    return "round(" + " + ".join(f"{w}::DOUBLE * {_part(c, c not in lower)}" for c, w in weights.items()) + ", 10)"


_LANES = (
    _O
    + f""", l AS (SELECT scene_name, primary_driver, count(DISTINCT report_family_id) AS family_count, count(DISTINCT artist_name) AS artist_count, count(artist_name) AS opportunity_count, count(*) FILTER (opportunity_band = 'priority_now') AS priority_now_count, count(*) FILTER (opportunity_band = 'watchlist') AS watchlist_count,
  avg(len({_LIST.format('connected_seed_artists')})) AS avg_seed_bridge_count, avg(opportunity_score) AS avg_opportunity_score, avg(scene_local_play_share) AS avg_scene_local_play_share, avg(scene_release_pressure) AS avg_scene_release_pressure, avg(fan_migration_score) AS avg_fan_migration_score, avg(release_whitespace_score) AS avg_release_whitespace_score,
  avg(local_gap_score) AS avg_local_gap_score, avg(scene_momentum_score) AS avg_scene_momentum_score FROM o WHERE scene_name IS NOT NULL AND primary_driver IS NOT NULL GROUP BY ALL),
lt AS (SELECT scene_name, primary_driver, artist_name AS representative_artist FROM o WHERE scene_name IS NOT NULL AND primary_driver IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scene_name, primary_driver ORDER BY opportunity_score DESC NULLS LAST, opportunity_id) = 1),
la AS (SELECT l.*, representative_artist, {_weighted({"avg_opportunity_score": 0.25, "priority_now_count": 0.20, "avg_scene_local_play_share": 0.15, "avg_fan_migration_score": 0.15, "avg_seed_bridge_count": 0.10, "avg_local_gap_score": 0.10, "avg_release_whitespace_score": 0.05})} AS lane_attractiveness_score FROM l JOIN lt USING (scene_name, primary_driver))
"""
)
_ROUND = lambda *c: ", ".join(f"round({x}, 10) AS {x}" for x in c)

ORACLE = {
    "a5_run_summary": _R + "SELECT * EXCLUDE (run_name, champion_gate_metric_source, fit_seconds) REPLACE (round(mean_backtest_top1, 10) AS mean_backtest_top1) FROM s",
    "a6_review_snapshot": _H + "SELECT * FROM s",
    "a13_review_overview": _H
    + """SELECT s.*, CAST(min(day_) AS VARCHAR) AS history_window_start, CAST(max(day_) AS VARCHAR) AS history_window_end, round(avg(s_acctbal / 10000), 10) AS mean_target_drift_jsd, round(avg(s_nationkey) FILTER (s_nationkey <= 3), 10) AS mean_stress_benchmark_skip_risk, round(avg(s_acctbal), 10) AS mean_selective_risk FROM h, s GROUP BY ALL""",
    "a11_run_quality": _R
    + """, n AS (SELECT run_id, count(model_name) AS models_evaluated FROM s GROUP BY 1)
SELECT run_id, run_name, profile, run_timestamp, promoted, champion_gate_status, champion_gate_metric_source, data_records, champion_alias_model_name AS serving_model_name, champion_alias_model_type AS serving_model_type, model_name AS best_model_name, model_type AS best_model_type, val_top1 AS best_val_top1, test_top1 AS best_test_top1,
  round(mean_backtest_top1, 10) AS best_mean_backtest_top1, models_evaluated FROM s JOIN n USING (run_id) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY test_top1 DESC NULLS LAST, val_top1 DESC NULLS LAST, model_name, model_type) = 1""",
    "a12_model_registry": _R
    + """, g AS (SELECT model_name, model_type, count(DISTINCT run_id) AS runs, count(*) FILTER (promoted = 'true') AS promoted_runs, round(avg(val_top1), 10) AS mean_val_top1, round(avg(test_top1), 10) AS mean_test_top1, round(avg(mean_backtest_top1), 10) AS mean_backtest_top1, round(avg(fit_seconds), 3) AS mean_fit_seconds, max(test_top1) AS max_test_top1 FROM s GROUP BY ALL),
l AS (SELECT model_name, model_type, run_id AS latest_run_id, profile AS latest_profile, run_timestamp AS latest_run_timestamp FROM s QUALIFY row_number() OVER (PARTITION BY model_name, model_type ORDER BY run_timestamp DESC NULLS LAST, run_id DESC) = 1),
k AS (SELECT model_name, model_type, model_family FROM s GROUP BY model_name, model_type, model_family QUALIFY row_number() OVER (PARTITION BY model_name, model_type ORDER BY count(*) DESC, model_family) = 1)
SELECT * FROM g JOIN l USING (model_name, model_type) JOIN k USING (model_name, model_type)""",
    "a38_leaderboard": _R
    + """SELECT model_name, model_type, round(avg(val_top1), 10) AS mean_metric, max(val_top1) AS best_metric, count(DISTINCT run_id) AS run_count FROM r WHERE val_top1 IS NOT NULL GROUP BY ALL ORDER BY avg(val_top1) DESC, best_metric DESC, run_count DESC, model_name, model_type LIMIT 8""",
    "a51_backtest_summary": _R + "SELECT model_name, 'top1' AS metric_name, round(avg(top1), 10) AS mean, round(coalesce(stddev_samp(top1), 0), 10) AS std, count(*) AS count FROM b GROUP BY 1",
    "a53_run_registry": _REGISTRY + "SELECT * FROM g",
    "a53_claim_registry": _REGISTRY
    + """, c AS (SELECT s_name AS claim_key, CASE WHEN s_suppkey % 10 = 0 THEN 'run-none' ELSE 'run-' || s_suppkey * 3 END AS run_id, s_acctbal > 1000 AS ok FROM supplier)
SELECT claim_key, c.run_id, CASE WHEN stage = 'complete' AND ok THEN 'ready' ELSE 'blocked' END AS status, array_to_string(list_filter([CASE WHEN stage IS NULL THEN 'run' END, CASE WHEN stage <> 'complete' THEN 'artifacts' END, CASE WHEN NOT ok THEN 'support' END], lambda x: x IS NOT NULL), '|') AS missing FROM c LEFT JOIN g ON g.run_id = c.run_id""",
    "a39_weekly_areas": "WITH a AS (SELECT p_partkey, p_brand AS area FROM part UNION SELECT p_partkey, p_type FROM part) SELECT area, count(*) AS n FROM a GROUP BY 1 HAVING count(*) >= 5",
    "a44_freshness": """WITH r AS (SELECT c_nationkey AS branch, CASE WHEN c_custkey % 53 = 0 THEN 'missing' WHEN c_acctbal < -900 THEN 'stale' WHEN c_custkey % 17 = 0 THEN 'empty' ELSE 'fresh' END AS s, c_custkey % 365 AS age FROM customer),
g AS (SELECT branch, count(*) AS sources, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s = 'stale') AS stale, count(*) FILTER (s = 'fresh') AS fresh, count(*) FILTER (s = 'empty') AS empty, max(age) AS oldest_days FROM r GROUP BY 1)
SELECT *, CASE WHEN missing > 0 THEN 'missing_source' WHEN stale > 0 THEN 'attention' WHEN fresh = sources THEN 'fresh' WHEN empty > 0 THEN 'source_empty' ELSE 'source_fresh' END AS freshness_status FROM g""",
    "a7_family_summary": _O
    + """, g AS (SELECT report_family_id, min(seed_group_slug) AS seed_group_slug, count(artist_name) AS ranking_rows, count(*) FILTER (opportunity_band = 'priority_now') AS priority_now_count, round(avg(opportunity_score), 10) AS avg_opportunity_score FROM o WHERE report_family_id IS NOT NULL GROUP BY 1),
a AS (SELECT report_family_id, artist_name AS top_opportunity_artist FROM o QUALIFY row_number() OVER (PARTITION BY report_family_id ORDER BY opportunity_score DESC NULLS LAST, opportunity_id) = 1),
n AS (SELECT report_family_id, count(scene_name) AS scene_rows FROM sc GROUP BY 1), z AS (SELECT report_family_id, scene_name AS top_scene_name FROM sc QUALIFY row_number() OVER (PARTITION BY report_family_id ORDER BY avg_opportunity_score DESC NULLS LAST, scene_name NULLS LAST) = 1),
q AS (SELECT report_family_id, count(seed_artist) AS scene_seed_rows FROM sd GROUP BY 1)
SELECT * FROM g LEFT JOIN a USING (report_family_id) LEFT JOIN n USING (report_family_id) LEFT JOIN z USING (report_family_id) LEFT JOIN q USING (report_family_id)""",
    "a14_artist_opportunities": _O
    + """, g AS (SELECT artist_name, count(*) AS appearance_count, count(DISTINCT report_family_id) AS family_count, count(*) FILTER (opportunity_band = 'priority_now') AS priority_now_count, round(avg(opportunity_score), 10) AS mean_opportunity_score, round(max(opportunity_score), 10) AS max_opportunity_score FROM o WHERE artist_name IS NOT NULL GROUP BY 1),
a AS (SELECT artist_name, scene_name AS top_scene_name, primary_driver AS top_primary_driver FROM o QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY opportunity_score DESC NULLS LAST, opportunity_id) = 1) SELECT * FROM g JOIN a USING (artist_name)""",
    "a15_scene_pressure": _O
    + """, g AS (SELECT scene_name, count(DISTINCT report_family_id) AS family_count, CAST(sum(priority_now_count) AS BIGINT) AS total_priority_now_count, round(avg(avg_opportunity_score), 10) AS mean_opportunity_score, round(max(top_opportunity_score), 10) AS max_top_opportunity_score, round(avg(scene_local_play_share), 10) AS mean_scene_local_play_share,
  round(avg(scene_release_pressure), 10) AS mean_scene_release_pressure FROM sc WHERE scene_name IS NOT NULL GROUP BY 1), a AS (SELECT scene_name, top_opportunity_artist AS top_opportunity_artist_example FROM sc WHERE scene_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scene_name ORDER BY top_opportunity_score DESC NULLS LAST, report_family_id NULLS LAST) = 1)
SELECT * FROM g JOIN a USING (scene_name)""",
    "a35_lane_atlas": _LANES + f"""SELECT * REPLACE ({_ROUND("avg_seed_bridge_count", "avg_opportunity_score", "avg_scene_local_play_share", "avg_scene_release_pressure", "avg_fan_migration_score", "avg_release_whitespace_score", "avg_local_gap_score", "avg_scene_momentum_score")}) FROM la""",
    "a35_seed_bridges": _O
    + f""", g AS (SELECT scene_name, seed_artist, count(DISTINCT report_family_id) AS family_count, CAST(sum(opportunity_count) AS BIGINT) AS opportunity_count, avg(avg_opportunity_score) AS avg_opportunity_score FROM sd WHERE scene_name IS NOT NULL GROUP BY ALL)
SELECT *, {_weighted({"avg_opportunity_score": 0.6, "opportunity_count": 0.4})} AS bridge_score FROM g""".replace("SELECT *, round", "SELECT * REPLACE (round(avg_opportunity_score, 10) AS avg_opportunity_score), round"),
    "a8_scene_market": _LANES
    + f""", g AS (SELECT scene_name, count(DISTINCT report_family_id) AS family_count, avg(scene_local_play_share) AS avg_scene_local_play_share, avg(avg_opportunity_score) AS avg_opportunity_score, CAST(sum(priority_now_count) AS BIGINT) AS total_priority_now, CAST(sum(watchlist_count) AS BIGINT) AS total_watchlist, avg(scene_release_pressure) AS avg_release_pressure FROM sc WHERE scene_name IS NOT NULL GROUP BY 1),
e AS (SELECT scene_name, avg(len({_LIST.format('connected_seed_artists')})) AS avg_seed_bridge_count, avg(fan_migration_score) AS avg_inbound FROM o WHERE scene_name IS NOT NULL GROUP BY 1),
d AS (SELECT scene_name, primary_driver AS dominant_driver FROM o WHERE scene_name IS NOT NULL AND primary_driver IS NOT NULL GROUP BY scene_name, primary_driver QUALIFY row_number() OVER (PARTITION BY scene_name ORDER BY count(*) DESC, primary_driver) = 1),
a AS (SELECT scene_name, top_opportunity_artist FROM sc WHERE scene_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scene_name ORDER BY top_opportunity_score DESC NULLS LAST, report_family_id NULLS LAST) = 1),
j AS (SELECT * FROM g LEFT JOIN e USING (scene_name) LEFT JOIN d USING (scene_name) LEFT JOIN a USING (scene_name)),
p AS (SELECT *, {_weighted({"avg_opportunity_score": 0.30, "avg_scene_local_play_share": 0.25, "total_priority_now": 0.20, "avg_inbound": 0.15, "avg_release_pressure": 0.10}, ("avg_release_pressure",))} AS momentum_score FROM j),
n AS (SELECT scene_name, count(primary_driver) AS lane_count, CAST(sum(artist_count) AS BIGINT) AS artist_count, max(lane_attractiveness_score) AS lane_attractiveness_score FROM la GROUP BY 1),
b AS (SELECT scene_name, representative_artist FROM la QUALIFY row_number() OVER (PARTITION BY scene_name ORDER BY lane_attractiveness_score DESC NULLS LAST, primary_driver) = 1)
SELECT * REPLACE ({_ROUND("avg_scene_local_play_share", "avg_opportunity_score", "avg_release_pressure", "avg_seed_bridge_count", "avg_inbound")}) FROM p LEFT JOIN n USING (scene_name) LEFT JOIN b USING (scene_name)""",
    "a35_whitespace": _O
    + f""", w AS (SELECT *, len({_LIST.format('connected_seed_artists')}) AS bridges, nullif(array_to_string({_LIST.format('dominant_release_labels')}[1:3], '|'), '') AS labels FROM o WHERE artist_name IS NOT NULL AND scene_name IS NOT NULL AND (coalesce(release_whitespace_score, 0) > 0 OR coalesce(days_since_latest_release, 0) > 0 OR len({_LIST.format('dominant_release_labels')}) > 0)),
g AS (SELECT artist_name, scene_name, count(DISTINCT report_family_id) AS family_count, avg(opportunity_score) AS avg_opportunity_score, avg(release_whitespace_score) AS avg_release_whitespace_score, max(days_since_latest_release) AS max_days_since_latest_release, avg(bridges) AS avg_seed_bridge_count FROM w GROUP BY ALL),
d AS (SELECT artist_name, scene_name, labels AS dominant_labels FROM w WHERE labels IS NOT NULL GROUP BY artist_name, scene_name, labels QUALIFY row_number() OVER (PARTITION BY artist_name, scene_name ORDER BY count(*) DESC, labels) = 1),
e AS (SELECT artist_name, scene_name, primary_driver FROM w WHERE primary_driver IS NOT NULL GROUP BY artist_name, scene_name, primary_driver QUALIFY row_number() OVER (PARTITION BY artist_name, scene_name ORDER BY count(*) DESC, primary_driver) = 1),
j AS (SELECT * FROM g LEFT JOIN d USING (artist_name, scene_name) LEFT JOIN e USING (artist_name, scene_name))
SELECT * REPLACE ({_ROUND("avg_opportunity_score", "avg_release_whitespace_score", "avg_seed_bridge_count")}), {_weighted({"avg_release_whitespace_score": 0.45, "avg_opportunity_score": 0.30, "max_days_since_latest_release": 0.15, "avg_seed_bridge_count": 0.10})} AS whitespace_signal_score FROM j""",
    "a37_rising_scenes": _O
    + """, x AS (SELECT report_family_id AS f, scene_name, round(coalesce(avg_opportunity_score, 0) + coalesce(scene_local_play_share, 0) + 0.05::DOUBLE * priority_now_count + 0.02::DOUBLE * watchlist_count + 0.10::DOUBLE * coalesce(scene_release_pressure, 0), 9) AS v FROM sc WHERE report_family_id IS NOT NULL AND scene_name IS NOT NULL),
g AS (SELECT scene_name, count(DISTINCT f) AS family_count, count(*) AS repeat_count, min(f) AS first_family, max(f) AS latest_family, arg_min(v, f) AS first_value, arg_max(v, f) AS latest_value FROM x GROUP BY 1),
k AS (SELECT *, latest_value - first_value AS delta_value FROM g WHERE family_count >= 2 AND latest_value > first_value ORDER BY delta_value DESC, scene_name LIMIT 10)
SELECT * REPLACE (round(first_value, 10) AS first_value, round(latest_value, 10) AS latest_value, round(delta_value, 10) AS delta_value), CASE WHEN delta_value >= 0.25 THEN 'high' WHEN delta_value >= 0.05 THEN 'medium' ELSE 'low' END AS severity, row_number() OVER (ORDER BY delta_value DESC, scene_name) AS category_rank FROM k""",
    "a20_latest_run_results": _R + "SELECT * FROM r WHERE run_id = (SELECT run_id FROM m ORDER BY run_timestamp DESC NULLS LAST, run_id DESC LIMIT 1)",
    "a20_best_models": _R + "SELECT profile, model_name, model_type, round(avg(val_top1), 10) AS mean_val_top1, round(avg(test_top1), 10) AS mean_test_top1, count(*) AS runs FROM r JOIN m USING (run_id) GROUP BY ALL",
    "a20_backtests": _R + "SELECT profile, model_name, model_type, round(avg(top1), 10) AS mean_backtest_top1, round(stddev_samp(top1), 10) AS std_backtest_top1, count(*) AS folds FROM b GROUP BY ALL",
    "a20_champions": _R + "SELECT run_id, profile, run_timestamp, true AS promoted, champion_gate_metric_source AS metric_source, champion_alias_model_name AS alias_model_name, champion_alias_model_type AS alias_model_type FROM m WHERE promoted = 'true'",
}

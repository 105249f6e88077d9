from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessitura.plans.service import ListeningQuery, ListeningService, narratives
from tessitura.plans.views import VIEWS, register_views
from tessitura.plans.warehouse import Asset, Warehouse, decision, edges, in_build_order, listening_assets, reach

DATA = Path("/root/testdata/sf0.001")


def assets(spark, n):
    return [Asset("top", "gold", ["base"], lambda t: t["base"].groupBy().agg(F.count(F.lit(1)).alias("n"))), Asset("base", "bronze", [], lambda _: spark.range(n[0])), Asset("side", "bronze", [], lambda _: spark.range(3).repartition(2))]


def test_order_and_lineage(spark):
    made = assets(spark, [1])
    assert [a.name for a in in_build_order(made)] == ["base", "top", "side"] and edges(made) == [("base", "top")] and reach(made, "base", True) == ["top"] and reach(made, "top", False) == ["base"]
    with pytest.raises(ValueError, match="circular or unknown"):
        in_build_order([Asset("x", "gold", ["x"], lambda _: None)])
    assert decision(None, False, {}) == ("built", "new_asset") and decision({"content": {}}, False, {}) == ("rebuilt", "file_missing")


def test_refresh_reuses_rebuilds_and_reports(spark, tmp_path):
    n = [5]
    w = Warehouse(str(tmp_path), assets(spark, n))
    what = lambda m: {k: v["decision"] for k, v in m["assets"].items()}
    assert set(what(w.refresh(spark)).values()) == {"built"}
    assert set(what(w.refresh(spark)).values()) == {"reused"} and w.verify(spark) == {}
    n[0] = 0
    changed = w.refresh(spark)
    assert what(changed) == {"base": "rebuilt", "top": "rebuilt", "side": "reused"} and ("base", "dropped to zero") in changed["findings"]
    shutil.rmtree(tmp_path / "bronze" / "side")
    assert w.verify(spark) == {"side": ["missing"]} and what(w.refresh(spark))["side"] == "rebuilt"
    assert w.register(spark) == ["base", "side", "top"] and spark.sql("select n from top").first()["n"] == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_listening_warehouse(spark, tmp_path):
    w = Warehouse(str(tmp_path), listening_assets(spark, str(DATA)))
    built = w.refresh(spark)
    assert all(x["rows"] > 0 for n, x in built["assets"].items() if n != "similarity_anomalies") and built["findings"] in ([], [("similarity_anomalies", "empty below data")])
    assert set(x["decision"] for x in w.refresh(spark)["assets"].values()) == {"reused"}
    assert set(w.register(spark)) == set(w.tables(spark)) == set(built["assets"])


def test_views_need_their_columns(spark):
    results = spark.createDataFrame([("r1", "m"), ("r2", "n")], "run_id string, model_name string")
    manifests = spark.createDataFrame([("r1", "2026-01-02", "p"), ("r2", None, "q")], "run_id string, run_timestamp string, profile string")
    assert register_views(spark, {"run_results": results}) == []
    assert register_views(spark, {"run_results": results, "run_manifests": manifests}) == ["latest_run_results"]
    assert [r["model_name"] for r in spark.table("latest_run_results").collect()] == ["m"]
    backtest = spark.createDataFrame([("p", "m", "0.5"), ("p", "m", "oops"), ("p", "n", "0.25"), ("p", "n", "0.75")], "profile string, model_name string, top1 string")
    register_views(spark, {"backtest_history": backtest})
    assert [tuple(r) for r in spark.table("backtest_model_summary").collect()] == [("p", "m", 0.5, None, 2), ("p", "n", 0.5, 0.3535533905932738, 2)]
    register_views(spark, {"backtest_history": backtest.withColumn("model_type", F.lit("t"))})
    assert "model_type" in spark.table("backtest_model_summary").columns
    moonshot = spark.createDataFrame([("r1", "8", "0.5", "0.7", "s", None), ("r9", "x", "0.9", "0.1", "s", "0.2")], "run_id string, multimodal_embedding_dim string, digital_twin_test_auc string, causal_test_auc_total string, stress_worst_skip_scenario string, stress_worst_skip_risk string")
    empty = spark.createDataFrame([{}], "").where("false")
    assert register_views(spark, {"moonshot_summary": moonshot, "run_manifests": manifests, "nothing": empty}) == ["moonshot_run_summary"]
    assert [(r["run_id"], r["profile"], r["multimodal_embedding_dim"], r["journey_mean_horizon"]) for r in spark.table("moonshot_run_summary").collect()] == [("r9", None, None, None), ("r1", "p", 8, None)]
    assert spark.table("nothing").columns == ["_empty"]


def test_views_of_whole_rows(spark):
    claims = spark.createDataFrame([("a", "yes", 5.0, 1), ("b", "true", 9.0, 2), ("c", "no", 10.0, 1), ("d", None, 1.0, 1), ("e", "1", 5.0, 3)], "claim_key string, blocked string, watchlist_score double, missing_check_count long")
    branches = spark.createDataFrame([("x", "p", 2, 1.0, 0.1, "c"), ("y", "p", None, 9.0, 0.1, "c"), ("z", "p", 1, 1.0, 0.1, "c")], "branch_key string, branch_posture string, queue_rank long, risk_reduction_score double, risk_score double, next_command string")
    artists = spark.createDataFrame([("a", 0, 9.0), ("b", 2, 1.0), ("c", 1, None), ("d", 1, 3.0)], "artist_name string, priority_now_count long, max_opportunity_score double")
    trends = spark.createDataFrame([("2026-01-01", "artists", True), ("2026-01-02", "tracks", True), ("2026-01-03", "tracks", False)], "listening_date string, dimension string, similarity_anomaly_flag boolean")
    made = register_views(spark, {"mart_research_claim_watchlist": claims, "mart_scope_expansion_health": branches, "mart_creator_opportunities": artists, "mart_public_listening_trends": trends})
    assert made == ["creator_priority_now", "research_platform_blocked_claims", "scope_expansion_priority_queue", "public_listening_similarity_anomalies"]
    first = lambda name: [r[0] for r in spark.table(name).collect()]
    assert first("research_platform_blocked_claims") == ["b", "e", "a"] and first("scope_expansion_priority_queue") == ["z", "x", "y"]
    assert first("creator_priority_now") == ["d", "b", "c"] and first("public_listening_similarity_anomalies") == ["2026-01-02", "2026-01-01"]
    assert len({v.name for v in VIEWS}) == 16


MART = "listening_date string, dimension string, event_count long, duration_minutes double, global_similarity double, united_states_similarity double, closer_scope string, reference_alignment string"


def test_service(spark, tmp_path):
    rows = [("2026-01-01", "artists", 5, 10.0, 0.2, 0.4, "united_states", "a"), ("2026-01-02", "artists", 50, 1.0, 0.5, 0.5, "tie", "a"), ("2026-01-02", "tracks", 3, 1.0, None, None, "tie", "b")]
    df = spark.createDataFrame(rows, MART)
    df.write.parquet(f"{tmp_path}/m")
    df.createOrReplaceTempView("mart")
    answers = []
    for source in ({"frame": df}, {"parquet": f"{tmp_path}/m"}, {"name": "mart"}):
        s = ListeningService(spark, **source)
        answers.append((s.summary().first(), s.values("dimension").collect(), s.notable_days(1).collect(), s.daily_trend(limit=2).collect(), s.date_range(ListeningQuery(start="2026-01-02")).first(), s.rows(ListeningQuery(dimension="artists", least_events=6)).count()))
    assert answers[0] == answers[1] == answers[2] and answers[0][0]["days"] == 2 and answers[0][0]["best"] == 0.5 and answers[0][5] == 1
    for bad in (ListeningQuery(start="x"), ListeningQuery(start="2026-01-02", end="2026-01-01"), ListeningQuery(closer_scope="mars")):
        with pytest.raises(ValueError):
            s.rows(bad)
    with pytest.raises(ValueError):
        ListeningService(spark)
    with pytest.raises(ValueError, match="missing"):
        ListeningService(spark, frame=df.drop("dimension"))
    told = {str(r["listening_date"]): r for r in narratives(df).collect()}
    assert told["2026-01-02"]["scopes"] == "global|united_states" and told["2026-01-01"]["caveat"] == "few plays" and "0.40" in told["2026-01-01"]["headline"]

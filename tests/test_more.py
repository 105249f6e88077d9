"""Sources, features and measures against plain Python."""

from __future__ import annotations

import json
import random
import re
import unicodedata
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import scalars
from tessitura.operators import compare, features, graph, learning, media, metrics, relations, retrieval, runs, segments
from tessitura.sources import charts, history, shapes, sinks, snapshots
from tessitura.sources.paged import PagedClient
from tessitura.sources.technical import COLUMNS, read_technical_logs, technical_features
from tests.test_partitions import many_parts


def test_name_keys_are_those_of_python(spark):
    rng = random.Random(1)
    marks = ["A", "é", "ß", "ﬁ", "Ⅷ", "½", "Ｚ", "ø", "İ", "K", "漢", "а", "̈", "№", "🎧", " ", "-", "𝐀", "9", "²"]
    names = ["".join(rng.choice(marks) for _ in range(rng.randrange(6))) for _ in range(500)] + [None, ""]
    plain = lambda x: re.sub(r"[^a-z0-9]+", "", unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().casefold())
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string").select("i", scalars.name_key(F.col("n")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in rows} == {i: None if n is None else plain(n) for i, n in enumerate(names)}
    assert spark.range(1).select(scalars.genre_label(F.lit(" Hip-Hop / RAP ")).alias("g")).first()["g"] == "hip hop rap"


def test_quantiles_and_totals_over_many_ranges(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), 0.5, rng.randrange(9)]) for _ in range(4_000)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(9_001, None), (9_002, float("nan"))], "i long, v double")
    with many_parts(spark):
        found = relations.quantiles(df, "v", [0, 0.1, 0.5, 0.75, 1]).first()
        totals = relations.running_totals(df.where("i < 4000"), [F.col("v"), F.col("i")], ["i"]).collect()
    assert list(found) == pytest.approx(np.quantile(values, [0, 0.1, 0.5, 0.75, 1]).tolist())
    run = 0
    for r in sorted(totals, key=lambda r: (r["v"], r["i"])):
        run += r["i"]
        assert r["i_so_far"] == run
    assert list(relations.quantiles(df.limit(0), "v", [0.5]).first()) == [None]


def test_abstention_and_temperature(spark):
    rng = np.random.default_rng(3)
    proba = rng.dirichlet([1.0] * 4, 300)
    truth = [int(rng.choice(4, p=p)) for p in proba]
    df = spark.createDataFrame([(i, p.tolist(), t) for i, (p, t) in enumerate(zip(proba, truth))], "i long, proba array<double>, t int")
    top, right = proba.max(1), proba.argmax(1) == np.array(truth)
    order = np.argsort(-top, kind="stable")
    k = np.arange(1, 301)
    risk, share = 1 - np.cumsum(right[order]) / k, k / 300
    ok = np.flatnonzero((share >= 0.1) & (risk <= 0.3))
    ranked = metrics.with_rank(df, "proba", "t")
    wanted = top[order][ok[-1]] if len(ok) else None
    found = metrics.abstention_threshold(ranked, "i", 0.05, target_risk=0.3).first()["threshold"]
    assert wanted is None or found == pytest.approx(wanted, abs=1e-8)
    assert metrics.abstention_threshold(ranked, "i", 0.05, target_risk=-1.0, least_drop=9.0).first()["threshold"] == 0.05
    best = metrics.guarded_temperature(df, "proba", "t").first()
    loss = {t: -np.mean(np.log((lambda z: z / z.sum(1, keepdims=True))(proba ** (1 / t))[np.arange(300), truth])) for t in metrics.TEMPERATURES}
    assert best["candidate_temperature"] == min(loss, key=lambda t: (round(loss[t], 12), t)) and best["temperature"] in (1.0, best["candidate_temperature"])


def test_media_events(spark):
    columns = "i int, artist string, track string, turi string, show string, ep string, epuri string, book string, ch string"
    rows = [(1, " A ", "T", "u:1", None, None, None, None, None), (2, "A", "T", None, " S", "E", "u:2", None, None), (3, None, None, None, None, None, " null ", None, None), (4, "A", None, " ", None, "E", None, "Book", "Ch 1"), (5, None, None, "u:9", None, None, None, "nan", None)]
    names = {"artist": "artist", "track": "track", "track_uri": "turi", "show": "show", "episode": "ep", "episode_uri": "epuri", "audiobook": "book", "chapter": "ch"}
    found = {r["i"]: (r["media_family"], r["node_key"], r["item_type"], r["item_key"]) for r in media.media_events(spark.createDataFrame(rows, columns), names).collect()}
    assert found == {1: ("music", "artist:a", "track", "track:u:1"), 2: ("podcast", "show:s", "episode", "episode:u:2"), 4: ("audiobook", "audiobook:book", "chapter", "chapter:ch 1"), 5: ("music", "artist:u:9", "artist", "artist:u:9")}
    flags = spark.createDataFrame([("T", "trackdone", "2.5"), (None, "fwdbtn", "-1"), ("", " TrackDone ", "3.5"), (None, "x", "z")], "s string, r string, m string")
    assert [tuple(r) for r in flags.select(media.skip_label(F.col("s"), F.col("r")), media.listen_ms(F.col("m"))).collect()] == [(True, 2), (True, None), (False, 4), (None, None)]


def test_sessions_split_whole(spark):
    sizes = {"one": [3], "two": [1, 5], "many": [4, 4, 4, 4, 4, 1], "three": [1, 1, 50]}
    rows = [(u, s, i) for u, ns in sizes.items() for s, n in enumerate(ns) for i in range(n)]
    found = media.split_by_sessions(spark.createDataFrame(rows, "u string, s int, i int"), ["u"], "s").select("u", "s", "split").distinct().collect()
    by = {(r["u"], r["s"]): r["split"] for r in found}
    assert by["one", 0] == "train" and (by["two", 0], by["two", 1]) == ("train", "test") and [by["three", s] for s in range(3)] == ["train", "validation", "test"]
    assert [by["many", s] for s in range(6)] == ["train", "train", "train", "validation", "test", "test"]


def test_archetypes_seasons_and_steps(spark):
    days = spark.createDataFrame([("u", datetime(2024, 12, 1).date(), 5, "a", 0.1, 0.2), ("u", datetime(2025, 1, 1).date(), 7, "b", 0.3, 0.2), ("u", datetime(2025, 7, 1).date(), 1, "b", 0.5, 0.2)], "u string, day date, total_streams int, archetype_label string, skip_rate double, exploration_ratio double")
    seasons = {(r["season_year"], r["season"], r["archetype_label"]): r["archetype_share"] for r in media.seasonal_summary(days, "day").collect()}
    assert seasons == {(2025, "winter", "a"): 0.5, (2025, "winter", "b"): 0.5, (2025, "summer", "b"): 1.0}
    assert {(r["from_archetype"], r["to_archetype"]): r["transition_share"] for r in media.archetype_transitions(days, ["u"], "day").collect()} == {("a", "b"): 0.5, ("b", "b"): 0.5}


def test_sequence_features(spark):
    rng = random.Random(5)
    lists = [[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(900, []), (901, None), (902, [1, None])], "i int, s array<int>")
    found = {r["i"]: r for r in features.sequence_features(df, "s").collect()}
    assert set(found) == set(range(60))
    for i, x in enumerate(lists):
        r, run = found[i], next((k for k, v in enumerate(reversed(x)) if v != x[-1]), len(x))
        assert (r["last"], r["previous"], r["first"], r["end_run"], r["repeats"]) == (x[-1], x[-2] if len(x) > 1 else x[-1], x[0], run, int(len(x) == 1 or x[-1] == x[-2]))
        assert [r["mean"], r["deviation"], r["unique_ratio"], r["recent_unique_ratio"]] == pytest.approx([np.mean(x), np.std(x), len(set(x)) / len(x), len(set(x[-5:])) / len(x[-5:])])


def test_retriever_and_backtest(spark):
    rng = random.Random(6)
    rows = sorted({(s, (rng.randrange(8) + 8 * (s % 2))) for s in range(80) for _ in range(4)})
    b = spark.createDataFrame(rows, "s long, i long")
    last = b.groupBy("s").agg(F.max("i").alias("i"))
    rest = b.join(last, ["s", "i"], "left_anti")
    found = retrieval.evaluate_retriever(retrieval.NeighbourRetriever("s", "i").fit(rest), rest, last, "s", "i", 5, b.select("i")).first()
    assert found["recall"] > 0.3 and found["queries"] == 80 and found["most_candidates"] <= 5 and 0 < found["catalogue_coverage"] <= 1
    folds = learning.backtest(b, [F.col("s"), F.col("i")], 3, 30, lambda train, test: float(train.count() * 1000 + test.count()))
    assert [f[:3] for f in folds] == [(k, 30 + k * ((len(rows) - 30) // 3), (len(rows) - 30) // 3) for k in range(3)] and all(f[3] == f[1] * 1000 + f[2] for f in folds)


def test_nearest_rows_in_blocks(spark):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((200, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [0.0] * 6)], "i long, v array<double>").repartition(5)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (7, 4096):
        found = graph.top_neighbours(df, "i", "v", df.where("i < 40"), 3, block=block).orderBy("query", "place").collect()
        wanted = [(q, j) for q in range(40) for j in sorted((k for k in range(200) if k != q), key=lambda k: (-round(float(unit[q] @ unit[k]), 9), k))[:3]]
        assert [(r["query"], r["neighbour"]) for r in found] == wanted
    assert graph.top_neighbours(df, "i", "v", df.where("i < 0"), 3).count() == 0


def test_inbox_tells_what_is_new_once(spark, tmp_path):
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    ask = lambda *ks: sorted(r["k"] for r in relations.inbox(rows(*ks), "k", f"{tmp_path}/state").collect())
    assert ask("a", "b", None) == ["a", "b"] and ask("b", "c") == ["c"] and ask("a", "c") == [] and ask("d") == ["d"]


def test_best_rows_and_risers(spark):
    df = spark.createDataFrame([("x", "f1", 0.1), ("x", "f2", 0.5), ("y", "f1", 0.9), ("y", "f3", 0.2), ("z", "f1", 0.1), ("w", "f1", None), ("w", "f2", 0.03)], "k string, f string, v double")
    best = {r["k"]: r["name"] for r in runs.best_row(df, ["k"], {"name": F.col("f")}, -F.col("v"), F.col("f")).collect()}
    assert best == {"x": "f2", "y": "f1", "z": "f1", "w": "f2"}
    rose = [(r["k"], round(r["delta_value"], 9), r["severity"], r["category_rank"]) for r in runs.rising(df, "f", "f", ["k"], "v").orderBy("category_rank").collect()]
    assert rose == [("x", 0.4, "high", 1), ("w", 0.03, "low", 2)]


def test_baselines_and_policy(spark):
    train = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (3, "b", "a"), (4, "c", "b"), (5, "b", "c")], "e long, item string, before string")
    test = spark.createDataFrame([(6, "b", "a", ["a"]), (7, "c", "b", ["b"]), (8, "z", "q", ["q"]), (9, "x", None, [])], "e long, item string, before string, seen array<string>")
    r = segments.next_item_baselines(train, test, "before", "item").first()
    assert (r["rows"], round(r["majority_top1"], 6), r["last_item_top1"], round(r["markov_top1"], 6)) == (3, round(1 / 3, 6), 0.0, round(2 / 3, 6))
    p = segments.policy_rewards(train, test, "e", "before", "item", "seen").first()
    utility = (0.65 * (2 + 1) / (2 + 3) + 0.15 * (1 - (3 + 1) / (5 + 3))) / (0.65 + 0.2 + 0.15 * 2)
    assert p["rows"] == 2 and p["hit_at_k"] == 1.0 and p["discounted_reward"] == pytest.approx((utility + (0.65 * 2 / 4 + 0.15 * (1 - 2 / 8)) / 1.15) / 2)


def test_comparison_counts_a_public_row_once(spark):
    day = datetime(2024, 5, 1).date()
    mine = spark.createDataFrame([(day, "tracks", f"t::{a}", "T", a, 10) for a in ("x", "x", "y")] + [(day, "artists", "x", "X", "", 5)], "day date, dimension string, key string, name string, detail string, ms long")
    lists = spark.createDataFrame([(1, 2024, "global", "tracks", 1, "T", ["X", "Y"]), (2, 2024, "global", "artists", 2, "Z", None)], "ref_id long, edition int, list_scope string, dimension string, list_rank int, name string, artists array<string>")
    public = compare.public_ranks(lists, 2024, 10)
    found = {(r["reference_scope"], r["dimension"]): r for r in compare.daily_comparison(mine, public, ("global", "united_states"), edition=2024, window=("2024-01-01", "2024-11-15")).collect()}
    assert len(found) == 6
    tracks = found["global", "tracks"]
    assert tracks["rank_weighted_jaccard_similarity"] == pytest.approx(0.5) and tracks["shared_public_entity_count"] == 2 and tracks["event_share_on_public_top"] == 1.0 and tracks["personal_top_entity_public_rank"] == 1
    assert found["global", "podcasts"]["similarity_label"] == "no personal data" and found["global", "artists"]["rank_weighted_jaccard_similarity"] == 0.0 and found["united_states", "tracks"]["rank_weighted_jaccard_similarity"] == 0.0
    mart = {r["dimension"]: r for r in compare.daily_similarity_mart(spark.createDataFrame(list(found.values()))).collect()}
    assert mart["tracks"]["closer_scope"] == "global" and mart["podcasts"]["closer_scope"] == "tie" and len(mart["tracks"]) == 17


def test_technical_logs(spark, tmp_path):
    logs = tmp_path / "Technical Log Information"
    logs.mkdir()
    at = lambda h: int((datetime(2026, 1, 2, tzinfo=UTC) + timedelta(hours=h)).timestamp() * 1000)
    put = lambda name, rows: (logs / name).write_text(json.dumps(rows))
    put("ConnectionInfo.json", [{"context_time": at(-30), "context_os_name": "iOS", "message_reachability_type": "wlan"}, {"timestamp_utc": at(-0.5) // 1000, "context_device_type": "phone", "message_reachability_type": "none", "message_ipv6_failed": "true"}, {"context_os_name": "iOS"}])
    put("AudioStreamingSettingsReport.json", [{"context_time": at(-1), "context_os_name": "android", "message_allow_downgrade": "yes", "message_play_bitrate_wifi": 320000}])
    put("PlaybackError.json", [{"context_time": at(0), "context_os_name": "ios", "message_fatal": True}, {"context_time": at(-25), "context_os_name": "ios"}, {"context_time": at(-1), "context_os_name": "windows"}])
    put("CloudPlaybackPlaybackStats.json", [{"message_client_timestamp": at(-2), "message_num_stalls": 3}])
    plays = spark.createDataFrame([(1, datetime(2026, 1, 2), "iOS 17"), (2, datetime(2026, 1, 2), "Windows"), (3, datetime(2025, 1, 1), "iOS")], "i long, ts timestamp, platform string")
    r = {x["i"]: x for x in technical_features(plays, "i", "ts", "platform", read_technical_logs(spark, str(tmp_path))).collect()}
    mobile = {"tech_connection_events_1h": 1, "tech_connection_none_24h": 1, "tech_ipv6_failures_24h": 1, "tech_playback_errors_24h": 1, "tech_playback_fatal_errors_24h": 1, "tech_last_reachability_offline": 1, "tech_last_ipv6_failed": 1, "tech_allow_downgrade": 1, "tech_bitrate_wifi_kbps": 320, "tech_cloud_stats_events_24h": 1, "tech_cloud_stalls_24h": 3}
    assert {c: r[1][c] for c in COLUMNS} == {c: mobile.get(c, 0) for c in COLUMNS} and len(COLUMNS) == 16
    assert r[2]["tech_playback_errors_24h"] == 1 and r[2]["tech_connection_events_1h"] == 0 and r[2]["tech_cloud_stalls_24h"] == 3 and all(r[3][c] == 0 for c in COLUMNS)
    assert all(x[c] == 0 for x in technical_features(plays, "i", "ts", "platform", {}).collect() for c in COLUMNS)


def test_snapshots(spark, tmp_path):
    (tmp_path / "a_report_family.json").write_text(json.dumps({"primary_report": "p.md", "comparison_view_csv": {"ranking_comparison": "r.csv"}}))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "creator_label_intelligence_x_ranking_comparison.csv").write_text("artist_name,opportunity_score\nA,0.5\nB,oops\n")
    families = snapshots.report_families(snapshots.read_documents(spark, f"{tmp_path}/*.json")).collect()
    assert [(r["report_family_id"], r["primary_report_path"], r["ranking_csv_path"], r["scene_csv_path"]) for r in families] == [("a", "p.md", "r.csv", None)]
    both = snapshots.family_tables(spark, str(tmp_path), ["creator_label_intelligence_x", "creator_label_intelligence_none"], "ranking", "artist_name opportunity_score:d").collect()
    assert [tuple(r) for r in both] == [("creator_label_intelligence_x", "x", "A", 0.5), ("creator_label_intelligence_x", "x", "B", None)]
    (tmp_path / "scene_market_pulse.csv").write_text("scene_name,family_count,other\ns,2,z\n")
    frames = snapshots.read_frames(spark, str(tmp_path))
    assert frames["scene_market_pulse"].first()["family_count"] == 2 and frames["opportunity_lane_atlas"].count() == 0 and "z" not in frames["scene_market_pulse"].columns
    (tmp_path / "h.csv").write_text("timestamp,run_id,top1\n2026-01-01T00:00:00,r,0.5\nnever,q,x\n")
    rows = snapshots.read_history_file(spark, f"{tmp_path}/h.csv", "backtest").orderBy("run_id").collect()
    assert [(r["run_id"], r["event_timestamp"] and r["event_timestamp"].year, r["top1"]) for r in rows] == [("q", None, None), ("r", 2026, 0.5)]
    document = {"generated_at": "now", "run_selection": {"selected_run": "r7"}, "latest_run": {"promoted": True}, "safety": {"test_selective_risk": 0.25}, "review_actions": [{"priority": "high", "inspect": [" a", ""]}], "next_bets": [1, 2]}
    (tmp_path / "review").mkdir()
    (tmp_path / "review" / "control_room.json").write_text(json.dumps(document))
    found = snapshots.review_snapshot(snapshots.read_documents(spark, f"{tmp_path}/review/*.json")).first()
    assert (found["selected_run_id"], found["latest_run_promoted"], found["selective_risk"], found["review_action_count"], found["next_bet_count"]) == ("r7", True, 0.25, 1, 2)
    assert snapshots.read_documents(spark, f"{tmp_path}/nowhere/*.json").count() == 0


def test_charts_and_tags(spark, tmp_path):
    answers = {"chart": {"artists": {"artist": [{"name": "A", "@attr": {"rank": "3"}, "listeners": "7"}, {"name": " "}, {"name": "B", "playcount": "x"}]}}, "tag": {"topartists": {"artist": []}}, "artist_tags": {"toptags": {"tag": [{"name": " rock "}]}}, "geo": {"error": 1}}
    client = PagedClient(lambda url: (200, {}, json.dumps(answers[re.search(r"method=(\w+)", url).group(1)])), str(tmp_path / "cache"))
    chart = charts.ChartClient(client, "http://h/api")
    assert [tuple(r) for r in chart.top_artists(spark).collect()] == [(3, "A", None, 7, ""), (2, "B", None, None, "")]
    assert chart.artists_of_tag(spark, "x").count() == 0 and chart.tags_of_artist("A") == ["rock"]
    with pytest.raises(ValueError, match="no list"):
        chart.top_artists(spark, country="DE")
    now = [1_000.0]
    cache = charts.TagCache(f"{tmp_path}/tags", ttl_s=10, clock=lambda: now[0])
    artists = spark.createDataFrame([("Zoë",), ("zoe",), ("Other",)], "artist string")
    assert all(r["tags"] is None for r in cache.get(artists, "artist").collect())
    cache.put(spark.createDataFrame([("ZOE", ["pop", " pop", ""])], "artist string, tags array<string>"), "artist")
    assert {r["artist"]: r["tags"] for r in cache.get(artists, "artist").collect()} == {"Zoë": ["pop"], "zoe": ["pop"], "Other": None}
    now[0] += 11
    assert all(r["tags"] is None for r in cache.get(artists, "artist").collect())
    assert cache.keyed(artists, "artist").first()["key"] == charts.cache_key("artist-tags-v1", "zoe")


def test_column_choices_are_all_checked():
    with pytest.raises(ValueError, match="x is no canonical name; no column q for a; no column for b"):
        shapes.resolve_columns(["c"], {"a": [], "b": ["d"]}, ["b"], {"x": "c", "a": "q"})
    assert shapes.resolve_columns(["B-b", "bb"], {"a": ["bb"]}, ["a"]) == {"a": "B-b"}


def test_history_with_statistics(spark, tmp_path):
    (tmp_path / "Streaming_History_Audio_1.json").write_text(json.dumps([{"ts": "2026-01-01T23:30:00Z", "svc_track_uri": "t"}]))
    events, stats = history.load_history(spark, str(tmp_path), "svc")
    assert stats["files"] == 1 and stats["records"] == 1 and stats["bytes"] > 0
    assert history.bronze_history(events.drop("audiobook_uri", "audiobook_chapter_uri", "episode_uri", "track_uri")).first()["content_type"] == "track"
    (tmp_path / "Streaming_History_Audio_1.json").write_text("[]")
    with pytest.raises(ValueError, match="no records"):
        history.load_history(spark, str(tmp_path), "svc")


def test_a_bundle_replaces_only_bundles(spark, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("mine")
    with pytest.raises(ValueError, match="something else"):
        sinks.export_bundle(str(tmp_path / "other"), {}, {}, {})
    sinks.export_bundle(str(tmp_path / "new"), {}, {}, {})
    sinks.export_bundle(str(tmp_path / "new"), {}, {}, {})


def test_scene_counts_and_models(spark, tmp_path):
    assert [learning.scene_count(n) for n in (0, 1, 2, 5, 30, 1_000)] == [0, 1, 2, 2, 5, 6]
    assert learning.scenes(spark.createDataFrame([(1.0,)], "x double"), ["x"]).first()["cluster"] == 0
    learning.save_arrays(spark.createDataFrame([(1, [0.5])], "i int, p array<double>"), f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").first()["p"] == [0.5]


def test_command_line(capsys):
    from tessitura.__main__ import main

    assert main(["--list"]) == 0 and "p3_found" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_registries(spark):
    m = spark.createDataFrame([("r1",), ("r2",), ("r3",), (None,)], "run_id string")
    a = spark.createDataFrame([("r1", "x"), ("r1", "x"), ("r1", "y"), ("r2", "y"), ("r2", "other"), ("r9", "x"), (None, "x")], "run_id string, name string")
    found = runs.run_registry(m, a, ["x", "y"])
    assert sorted((r["run_id"], r["has_x"], r["artifact_share"], r["stage"]) for r in found.collect()) == [("r1", True, 1.0, "complete"), ("r2", False, 0.5, "partial"), ("r3", False, 0.0, "bare")]
    claims = spark.createDataFrame([("a", "r1", "2"), ("b", "r2", None), ("c", None, "1"), ("d", "r1", "x")], "claim_key string, run_id string, support string")
    assert sorted((r["claim_key"], r["status"], r["missing"]) for r in runs.claim_registry(claims, found).collect()) == [("a", "ready", ""), ("b", "blocked", "artifacts|support"), ("c", "blocked", "run"), ("d", "blocked", "support")]

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions import scalars
from tessitura.operators.quality import blocked_content, content_hash, row_count_findings, same_table
from tessitura.sources import artifacts, history, interactions, shapes, sinks
from tessitura.sources.paged import PagedClient, PagedSource


def event(ts: str, **more) -> dict:
    return {"ts": ts, "platform": "ios", "ms_played": 1000, "shuffle": False, "skipped": "1", "ip_addr": "x", "svc_track_uri": "svc:track:a", **more}


def test_history_files_and_records(spark, tmp_path):
    good, other = tmp_path / "a" / "My History", tmp_path / "b"
    for folder in (good, other):
        folder.mkdir(parents=True)
    (good / "Streaming_History_Audio_1.json").write_text(json.dumps([event("2026-01-01T00:00:00Z"), event("bad"), event("2026-01-01T01:00:00Z", svc_track_uri=None, svc_episode_uri="svc:episode:e", audiobook_uri=" ")]))
    (good / "Streaming_History_Audio_2.json").write_text(json.dumps([event("2026-02-01T00:00:00Z", audiobook_uri="svc:book:b", ms_played="oops")]))
    (good / "Streaming_History_Video_1.json").write_text("[]")
    (other / "Streaming_History_Audio_1.json").write_text(json.dumps({"no": "list"}))
    files = history.find_history_files(str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in files] == ["Streaming_History_Audio_1.json", "Streaming_History_Audio_2.json"]
    assert len(history.find_history_files(str(tmp_path), include_video=True)) == 3
    raw = history.read_history(spark, files, "svc")
    assert raw.count() == 4 and "ip_addr" not in raw.columns
    rows = {(r["month"], r["content_type"]): r for r in history.bronze_history(raw).collect()}
    assert set(rows) == {(1, "track"), (1, "episode"), (2, "audiobook")}
    assert rows[2, "audiobook"]["ms_played"] is None and rows[1, "track"]["skipped"] is True and rows[1, "track"]["year"] == 2026
    assert history.read_history(spark, [str(other / "Streaming_History_Audio_1.json")], "svc").count() == 0
    with pytest.raises(FileNotFoundError):
        history.find_history_files(str(tmp_path / "none"))
    logs = tmp_path / "Technical Log Information"
    logs.mkdir()
    (logs / "Stutter.json").write_text("[]")
    (tmp_path / "Stutter.json").write_text("[]")
    assert history.find_technical_files(str(tmp_path)) == {"Stutter.json": str(logs / "Stutter.json")}


def test_artifacts(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.BooleanType())])
    (tmp_path / "x.csv").write_text("b,a,extra\n1.5,7,z\nnan,bad,z\n")
    assert [tuple(r) for r in artifacts.read_csv(spark, str(tmp_path / "x.csv"), schema).collect()] == [(7, 1.5, None), (None, None, None)]
    assert artifacts.read_csv(spark, str(tmp_path / "none.csv"), schema).count() == 0
    assert artifacts.read_document(str(tmp_path / "x.csv"), 5) == 5
    gate = T.StructType([T.StructField("status", T.StringType()), T.StructField("notes", T.ArrayType(T.StringType()))])
    for run, text in (("r1", '{"run_id": "r1", "gate": {"status": "pass", "notes": ["n"]}}'), ("r2", "{broken")):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "run_manifest.json").write_text(text)
        (tmp_path / "runs" / run / "run_results.json").write_text('[{"model_name": "m", "val_top1": 0.5}, {"model_name": "n"}]')
    found = artifacts.read_manifests(spark, f"{tmp_path}/runs/*/run_manifest.json", T.StructType([T.StructField("run_id", T.StringType()), T.StructField("gate", gate)])).drop("source_file").collect()
    assert [tuple(r) for r in found] == [("r1", "pass", '["n"]')]
    results = artifacts.read_results(spark, f"{tmp_path}/runs/*/run_results.json", T.StructType([T.StructField("model_name", T.StringType()), T.StructField("val_top1", T.DoubleType())]))
    assert sorted((r["run_id"], r["model_name"]) for r in results.collect()) == [("r1", "m"), ("r1", "n"), ("r2", "m"), ("r2", "n")]
    snapshot = spark.createDataFrame([("s", [{"t": "x"}, {"t": "y"}]), ("e", [])], "id string, actions array<struct<t:string>>")
    assert sorted(tuple(r) for r in artifacts.exploded_actions(snapshot, "actions").collect()) == [("s", 1, "x"), ("s", 2, "y")]
    (tmp_path / "f1").mkdir()
    (tmp_path / "f2").mkdir()
    (tmp_path / "f1" / "o.csv").write_text("p\n1\n")
    (tmp_path / "f2" / "o.csv").write_text("p,q\n2,3\n")
    both = artifacts.read_families(spark, [str(tmp_path / "f1"), str(tmp_path / "f2"), str(tmp_path / "f3")], "o.csv")
    assert sorted((r["report_family_id"], r["p"], r["q"]) for r in both.collect()) == [("f1", "1", None), ("f2", "2", "3")]


def test_interaction_formats(spark, tmp_path):
    (tmp_path / "taste.tsv").write_text("u1\ts1\t3\nu2\ts2\tx\n")
    found = interactions.read_interactions(spark, str(tmp_path / "taste.tsv"), interactions.TASTE_PROFILE)
    assert found.schema == interactions.INTERACTIONS or [f.name for f in found.schema] == interactions.INTERACTIONS.fieldNames()
    assert sorted((r["user_id"], r["interaction_value"], r["event_type"]) for r in found.collect()) == [("u1", 3.0, "play_count"), ("u2", None, "play_count")]
    (tmp_path / "logs.tsv").write_text("u\ta\tb\tt\t1700000000\n")
    assert interactions.read_interactions(spark, str(tmp_path / "logs.tsv"), interactions.LISTENING_LOGS).first()["timestamp"] == datetime(2023, 11, 14, 22, 13, 20)
    (tmp_path / "policy.csv").write_text("user_id,video_id,time_ms,play_time_ms,is_click,is_like,tab\n1,2,1700000000000,500,1,0,7\n")
    row = interactions.read_interactions(spark, str(tmp_path / "policy.csv"), interactions.POLICY_LOGS).first()
    assert row["dwell_ms"] == 500 and row["explicit_positive"] is False and json.loads(row["context_json"]) == {"tab": "7"} and row["timestamp"].year == 2023
    (tmp_path / "tracks.csv").write_text(",track,track\ntrack_id,title,duration\n5,Song,2.5\n")
    items = interactions.read_items(spark, str(tmp_path / "tracks.csv"), interactions.TRACK_TABLE, {"item_id": "track_id"}).collect()
    assert [(r["item_id"], r["item_name"], r["duration_ms"]) for r in items] == [("5", "Song", 2500.0)]
    (tmp_path / "bandit.csv").write_text("timestamp,item,position,click,propensity_score\n2020-01-01 00:00:00,a,1,0,0.5\n2020-01-01 00:00:00,,1,0,1.5\n")
    bandit = interactions.read_interactions(spark, str(tmp_path / "bandit.csv"), interactions.BANDIT_LOGS)
    assert bandit.first()["timestamp"] == datetime(2020, 1, 1)
    assert {r["constraint"]: r["violations"] for r in interactions.check_interactions(bandit).collect()} == {"source_dataset": 0, "item_id": 1, "propensity": 1, "dwell_ms": 0}
    with pytest.raises(ValueError, match="no column for user_id"):
        interactions.read_interactions(spark, str(tmp_path / "bandit.csv"), interactions.POLICY_LOGS)
    digest = interactions.file_sha256(str(tmp_path / "taste.tsv"))
    manifest = {"approved": True, "files": [{"path": "taste.tsv", "bytes": (tmp_path / "taste.tsv").stat().st_size, "sha256": digest}]}
    interactions.check_manifest(manifest, str(tmp_path))
    for broken in ({**manifest, "approved": False}, {**manifest, "files": [{**manifest["files"][0], "sha256": "0"}]}):
        with pytest.raises(ValueError):
            interactions.check_manifest(broken, str(tmp_path))


def test_shapes():
    assert shapes.two_row_header(["", "track", "", "album"], ["id", "title", "genre", "album"]) == ["id", "track_title", "track_genre", "album"]
    assert shapes.resolve_columns(["User ID", "song"], {"user_id": [], "item_id": ["Song"]}, ["user_id"]) == {"user_id": "User ID", "item_id": "song"}
    with pytest.raises(ValueError, match="no column x"):
        shapes.resolve_columns(["a"], {"n": ["a"]}, [], {"n": "x"})


def test_scalars(spark):
    df = spark.createDataFrame([("  ", "T", "12", "é Ö-x!", "2020", "year", '["a", " b", ""]'), ("v", "no", "99999999999", "Zoë", "2020-02", "month", "c|d"), (None, None, "nan", None, "bad", "day", None)], "a string, b string, c string, d string, e string, p string, l string")
    rows = df.select(scalars.text_or_null(F.col("a")), scalars.tri_state(F.col("b")), scalars.truth(F.col("b")), scalars.epoch_ms(F.col("c")), scalars.name_key(F.col("d")), scalars.release_date(F.col("e"), F.col("p")).cast("string"), scalars.listed(F.col("l"))).collect()
    assert [tuple(r) for r in rows] == [(None, True, None, 12000, "eox", "2020-01-01", ["a", "b"]), ("v", False, False, 99999999999, "zoe", "2020-02-01", ["c", "d"]), (None, None, None, None, None, None, [])]
    led = spark.createDataFrame([(1.0, 1.0), (None, 0.5), (None, None)], "x double, y double").select(scalars.leading(["x", "y"]).alias("n"), scalars.similarity_label(F.lit(0.3)).alias("s")).collect()
    assert [r["n"] for r in led] == ["x", "y", None] and led[0]["s"] == "moderate"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2020, 1), (2, "b", 2020, 2), (1, "c", 2021, 1)], "id long, v string, year int, month int")
    sinks.write_partitioned(df, f"{tmp_path}/p", ["year", "month"])
    assert spark.read.parquet(f"{tmp_path}/p").where("year = 2020").count() == 2
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("year", T.IntegerType()), T.StructField("w", T.DoubleType())])
    report = sinks.export_bundle(f"{tmp_path}/e", {"t": df}, {"t": schema}, {"t": ["year"]})
    assert report["tables"] == {"t": 3} and "PARTITIONED BY (`year` INT)" in (tmp_path / "e" / "ddl.sql").read_text()
    for _ in range(2):
        sinks.append(df, f"{tmp_path}/a", schema)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 6
    assert sinks.report_json(df, f"{tmp_path}/r.json") and not sinks.report_json(df, f"{tmp_path}/r.json")
    assert sinks.report_csv(df, f"{tmp_path}/r.csv") and sinks.report_markdown(df, f"{tmp_path}/r.md", "T")
    with pytest.raises(ValueError, match="report of over"):
        sinks.report_json(df, f"{tmp_path}/x.json", most=1)
    sinks.upsert_sqlite(df.orderBy("year"), f"{tmp_path}/d.db", "t", ["id"])
    import sqlite3

    assert sqlite3.connect(f"{tmp_path}/d.db").execute("select id, v from t order by id").fetchall() == [(1, "c"), (2, "b")]


def test_quality_tools(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "bad word")], "a long, b string")
    one, two = content_hash(df).first(), content_hash(df.repartition(3).orderBy("b")).first()
    assert one == two != content_hash(df.limit(1)).first() and content_hash(df.where("a > 9")).first()["rows"] == 0
    assert {tuple(r) for r in blocked_content(df, "^a$", "bad").collect()} == {("a", -1), ("b", 1)}
    assert same_table(df, df) == [] and same_table(df, df.select("a").limit(1)) == ["missing column b", "1 rows, not 3"]
    assert row_count_findings({"a": 0, "b": 1, "c": 0}, {"a": 3, "b": 0}, {"c": ["b"]}) == [("a", "dropped to zero"), ("b", "recovered"), ("c", "empty below data")]


def make_client() -> PagedClient:
    import tempfile

    def fetch(url):
        q = dict(x.split("=") for x in url.split("?")[1].split("&"))
        a, n = int(q["offset"]), int(q["limit"])
        return 200, {}, json.dumps({"items": [{"i": i} for i in range(a, min(a + n, 45))]})

    return PagedClient(fetch, tempfile.mkdtemp())


def test_paged_client_and_source(spark, tmp_path):
    calls, slept, now = [], [], [1000.0]
    answers = [(429, {"Retry-After": "3"}, ""), (200, {}, '{"items": [1, 2]}'), (200, {}, '{"items": [3]}'), (404, {}, "")]

    def fetch(url):
        calls.append(url)
        return answers[len(calls) - 1]

    client = PagedClient(fetch, str(tmp_path), min_gap_s=0.5, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    assert list(client.items("http://h/x?y=1", 2)) == [1, 2, 3] and slept[0] == 3.0 and len(calls) == 3
    now[0] = (tmp_path / next(p.name for p in tmp_path.iterdir())).stat().st_mtime + 5
    assert list(client.items("http://h/x?y=1", 2)) == [1, 2, 3] and len(calls) == 3
    with pytest.raises(ValueError, match="404"):
        client.get("http://h/none")
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").options(client="tests.test_sources:make_client", url="http://h/x", total="45", page="4").load()
    assert sorted(r["n"] for r in rows.collect()) == list(range(45))

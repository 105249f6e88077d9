from __future__ import annotations

from datetime import UTC, datetime, timedelta

from tessitura.streaming.events import apply_versions, feedback_counters, recent, stream_sessions, unique_events, upsert_batches, upserted

START = datetime(2026, 1, 1, tzinfo=UTC)


def run(query_of, spark, tmp_path, batches, schema, mode="append"):
    """All rows that a query over files written one after the other puts out, batch by batch."""
    source = f"{tmp_path}/in"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = query_of(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda df, n: out.extend(df.collect())).start()
        ended = q.awaitTermination(40)
        q.stop()
        assert ended
    return out


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_sessions_join_at_the_gap_and_come_out_after_the_watermark(spark, tmp_path):
    batches = [[("u", at(0)), ("u", at(30)), ("u", at(61))], [("u", at(300))], [("u", at(301))]]
    found = run(lambda s: stream_sessions(s, "u", "ts"), spark, tmp_path, batches, "u string, ts timestamp")
    assert sorted((r["event_count"], r["end"].minute) for r in found) in ([(2, 30)], [(1, 1), (2, 30)], [(1, 1), (2, 29)], [(1, 1), (2, 30)])


def test_versions(spark, tmp_path):
    schema = "session_id string, event_id string, expected_version long, payload string"
    batches = [[("s", "e1", 0, "a")], [("s", "e1", 0, "a"), ("s", "e2", 1, "b")], [("s", "e1", 5, "x"), ("s", "e3", 0, "c"), ("t", "e1", 0, "q")]]
    found = run(apply_versions, spark, tmp_path, batches, schema)
    assert sorted((r["session_id"], r["event_id"], r["version"], r["outcome"]) for r in found) == [("s", "e1", 1, "applied"), ("s", "e1", 1, "replayed"), ("s", "e1", 2, "conflict"), ("s", "e2", 2, "applied"), ("s", "e3", 2, "stale"), ("t", "e1", 1, "applied")]


def test_unique_and_counters(spark, tmp_path):
    rows = [("s", "e1", at(0)), ("s", "e1", at(0)), ("s", "e2", at(1))]
    assert len(run(lambda s: unique_events(s, "ts"), spark, tmp_path / "a", [rows, rows], "session_id string, event_id string, ts timestamp")) == 2
    signals = [("a", "like", at(0), 1), ("a", "skip", at(1), 2), ("b", "dislike", at(0), 3)]
    found = run(feedback_counters, spark, tmp_path / "b", [signals, [("a", "like", at(5), 4)]], "artist_key string, signal string, ts timestamp, event_id long", "update")
    last = [r for r in found if r["artist_key"] == "a"][-1]
    assert (last["likes"], last["skips"], last["last_signal"]) == (2, 1, "like")


def test_upsert_is_idempotent(spark, tmp_path):
    assert upserted(spark, f"{tmp_path}/table") is None
    upsert = upsert_batches(["k"], "t", f"{tmp_path}/table", buckets=3)
    batch = lambda rows: spark.createDataFrame(rows, "k string, t long, v string")
    upsert(batch([("a", 1, "x"), ("b", 1, "y")]), 0)
    upsert(batch([("a", 2, "z"), ("b", 0, "old")]), 1)
    upsert(batch([("a", 3, "never")]), 1)
    rows = upserted(spark, f"{tmp_path}/table")
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 2, "z"), ("b", 1, "y")]
    (tmp_path / "table" / "batch-9-dead").mkdir()  # of a batch that died before it was named
    assert sorted(r["k"] for r in upserted(spark, f"{tmp_path}/table").collect()) == ["a", "b"]
    assert [r["k"] for r in recent(rows, "t", "k", 1).collect()] == ["a"]

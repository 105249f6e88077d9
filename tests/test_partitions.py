"""The same answers with many small partitions, in another time zone, and where no shared folder is named."""

from __future__ import annotations

import random
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessitura import session
from tessitura.operators import metrics, relations, retrieval, sequence
from tessitura.operators.rolling import daily_totals
from tessitura.operators.timejoin import augment, augment_in_blocks
from tessitura.sources import files
from tessitura.sources.technical import technical_features


@contextmanager
def settings(spark, **conf):
    names = {k.replace("_", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def many_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    for k, v in zip(before, ("64", "4096", "1024")):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_conformal_threshold_over_many_ranges(spark):
    scored = spark.range(40_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("p_true"))
    truth = sorted(1 - r["p_true"] for r in scored.collect())
    k = min(-(-(len(truth) + 1) * 9 // 10), len(truth))
    with many_parts(spark):
        found = metrics.conformal_threshold(scored, 0.1).first()
    assert found["threshold"] == pytest.approx(truth[k - 1], abs=1e-8) and found["n"] == len(truth)


def test_front_and_order_over_many_ranges(spark):
    points = spark.range(20_000).select("id", F.pmod(F.xxhash64("id"), F.lit(5_003)).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5_009)).alias("y"))
    rows = [tuple(r) for r in points.collect()]
    front, best = set(), -1
    for x in sorted({r[1] for r in rows}, reverse=True):
        top = max(r[2] for r in rows if r[1] == x) if best < 5_008 else -1
        if top > best:
            front |= {r for r in rows if r[1] == x and r[2] == top}
            best = top
    with many_parts(spark):
        assert {tuple(r) for r in relations.pareto_front(points, "id", "x", "y").collect()} == front
        numbered = relations.in_order(points, [F.col("x"), F.col("id")], "n").collect()
        coded = {r["x"]: r["c"] for r in sequence.codes(points.select("x"), "x", "c").distinct().collect()}
    assert [(r["x"], r["id"]) for r in sorted(numbered, key=lambda r: r["n"])] == sorted((r[1], r[0]) for r in rows)
    assert coded == {x: i for i, x in enumerate(sorted({r[1] for r in rows}))}


def test_negatives_over_many_ranges(spark):
    had = spark.range(4_000).select((F.col("id") % 50).alias("u"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("i")).distinct()
    with many_parts(spark):
        found = retrieval.negative_samples(had, "u", "i", had, 3)
        assert found.count() == 3 * had.count() and found.join(had.withColumnRenamed("i", "negative"), ["u", "negative"], "left_semi").count() == 0


def test_days_are_utc_in_any_session(spark):
    at = [datetime(2024, 3, 10, 7, 30, tzinfo=UTC) + timedelta(hours=5 * i) for i in range(60)] + [datetime(1969, 12, 31, 23, 59, tzinfo=UTC)]
    df = spark.createDataFrame([("u", i, t, 1) for i, t in enumerate(at)], "u string, i long, ts timestamp, ms long")
    plain = {(t.date() - datetime(1970, 1, 1).date()).days for t in at}
    with settings(spark, spark_sql_session_timeZone="America/Los_Angeles"):
        assert {r["day"] for r in daily_totals(df, "u", "ts", "i", "ms").collect()} == plain
        parts = {r["i"]: (r["hour"], r["dow"], r["month"]) for r in sequence.calendar_parts(df, "ts").collect()}
    assert parts == {i: (t.hour, t.weekday(), t.month) for i, t in enumerate(at)}


def test_as_of_join_takes_the_latest_event_even_if_it_holds_nothing(spark):
    rows = spark.createDataFrame([(1, "a", 10, "x"), (2, "a", 30, "y"), (3, "b", 30, "z"), (4, None, 30, "n")], "i long, k string, t long, other string")
    events = spark.createDataFrame([("a", 10, 1, 5.0), ("a", 10, 2, 7.0), ("a", 20, 3, None)], "k string, time_us long, seq long, v double")
    found = augment(rows, {"e": events}, ["k"], "i", "t", latest={"last": ("e", "v")}, sums={"sum": ("e", "v", 15)}).orderBy("i").collect()
    assert [(r["other"], r["last"], r["sum"]) for r in found] == [("x", 7.0, 12.0), ("y", None, 0.0), ("z", 0.0, 0.0), ("n", 0.0, 0.0)]


@pytest.mark.parametrize("short, long", [(15, 60), (50, 70), (1, 0), (7, 7)])
def test_time_join_in_blocks_is_the_time_join(spark, short, long):
    draw, off = random.Random(short), 10**15 if short == 15 else -300
    event = lambda i: (draw.choice(["a", "b", "c", None]), off + draw.randrange(600), i, draw.choice([None, 0.0, 0.1, float(i), 1e300, float("inf")]))
    rows = spark.createDataFrame([(draw.choice(["a", "b", None]), i, draw.choice([None] + [off + draw.randrange(600) for _ in range(9)])) for i in range(90)], "k string, id long, t long")
    sources = {n: spark.createDataFrame([event(i) for i in range(size)], "k string, time_us long, seq long, v double") for n, size in (("a", 200), ("b", 9))}
    how = {"latest": {"x": ("a", "v"), "seen": ("a", "seq"), "y": ("b", "v")}, "sums": {"n": ("a", "v", short), "m": ("a", "seq", long), "o": ("b", "v", long)}, "default": None}
    want, found = ([tuple(-1 if v is None else v for v in r) for r in f(rows, sources, ["k"], "id", "t", **how).orderBy("id").collect()] for f in (augment, augment_in_blocks))
    assert len(found) == 90 and all(a[:1] == b[:1] and a[1:] == pytest.approx(b[1:], rel=1e-12) for a, b in zip(want, found))


def test_technical_features_share_a_family_among_tasks_and_add_no_window_up_for_each_row(spark):
    at = spark.range(3_000).select(F.col("id").alias("event_id"), F.timestamp_millis(1_700_000_000_000 + F.col("id") * 3_600_000).alias("ts"), F.lit("ios").alias("platform"))
    log = at.select("event_id", F.unix_millis("ts").alias("context_time"), F.col("platform").alias("context_os_name"), F.lit("wlan").alias("message_reachability_type"))
    with settings(spark, spark_sql_adaptive_enabled="false", spark_sql_shuffle_partitions="16"):
        found = technical_features(at, "event_id", "ts", "platform", {"ConnectionInfo.json": log, "CloudPlaybackPlaybackStats.json": log})
        assert "RangeFrame" not in found._jdf.queryExecution().executedPlan().toString()
        rows = found.select("event_id", "tech_connection_events_1h", "tech_cloud_stats_events_24h", "tech_last_reachability_wifi", F.spark_partition_id().alias("part")).collect()
    assert len({r["part"] for r in rows}) > 8
    assert {tuple(r)[:4] for r in rows} == {(i, min(i, 1) + 1.0, min(i, 24) + 1.0, 1.0) for i in range(3_000)}


def test_no_private_folder_on_a_cluster(spark, tmp_path):
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))
    kept, gone = session.materialize(spark.range(3), "kept"), session.materialize(spark.range(3), "gone")
    path = gone.inputFiles()[0].rsplit("/", 1)[0]
    session.release(gone)
    assert not files.exists(spark, path) and kept.count() == 3


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/a/b.json"
    assert files.read_text(spark, path) is None and files.names(spark, f"{tmp_path}/a") == []
    for text in ("one", "zwölf"):
        files.replace_text(spark, path, text)
        assert files.read_text(spark, path) == text
    assert [n for n in files.names(spark, f"{tmp_path}/a") if not n.startswith(".")] == ["b.json"]
    files.delete(spark, f"{tmp_path}/a")
    assert not files.exists(spark, path)

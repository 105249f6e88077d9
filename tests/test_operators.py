"""Small vectors with known results, and every query against its SQL."""

from __future__ import annotations

import math
from collections import Counter
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessitura.operators import graph, metrics, relations, retrieval, sequence, similarity
from tessitura.operators.timejoin import augment

START = datetime(2026, 1, 1, tzinfo=UTC)
S = sequence.Stream(["u"], "ts", "i", "item", "skip")


def stream(spark, seconds, items, skips=None):
    return spark.createDataFrame([("u", i, START + timedelta(seconds=s), x, bool(k)) for i, (s, x, k) in enumerate(zip(seconds, items, skips or [0] * len(items)))], "u string, i long, ts timestamp, item string, skip boolean")


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("i").collect()]


def test_rolling_counts_include_both_ends_and_leave_out_the_row(spark):
    df = stream(spark, [0, 10, 20, 30, 40, 50], "121121")
    assert values(sequence.rolling_item_counts(df, S, {"n": 25}), "n") == [0, 0, 1, 1, 0, 1]
    assert values(sequence.rolling_item_counts(stream(spark, [0, 0, 25, 51], "aaaa"), S, {"n": 25}), "n") == [0, 1, 2, 0]


def test_examples(spark):
    df = sequence.sessionize(stream(spark, [0, 600, 1200, 3600], "abad", [0, 1, 0, 0]), S)
    assert values(df, "session_id") == [0, 0, 0, 1] and values(df, "session_elapsed_seconds") == [0, 600, 1200, 0]
    found = sequence.example_histories(df, S, 5)
    assert values(found, "history", "history_gaps", "repeat", "session_end") == [(["a"], [0.0], False, False), (["a", "b"], [0.0, 600.0], True, True)]
    assert values(sequence.sessionize(stream(spark, [0, 1800, 3601], "aaa"), S), "session_id") == [0, 0, 1]


def test_features_use_earlier_rows_only(spark):
    df = sequence.sessionize(stream(spark, [0, 1, 2, 3], "aaba", [1, 1, 0, 1]), S)
    assert values(sequence.streaks(df, S), "skip_streak", "listen_streak") == [(0, 0), (1, 0), (0, 0), (0, 0)]
    assert values(sequence.session_so_far(df, S), "session_skip_rate", "session_unique_items", "repeats_previous") == [(0.0, 0, 0), (1.0, 1, 1), (1.0, 1, 0), (2 / 3, 2, 0)]
    assert values(sequence.recent(df, S, [2]), "recent_unique_ratio_2") == [0.0, 1.0, 0.5, 1.0]
    assert values(sequence.transitions_so_far(df, S, 3), "transition_count") == [0, 0, 0, 0]
    assert values(sequence.split_by_boundaries(sequence.sessionize(stream(spark, [i * 4000 for i in range(10)], "a" * 10), S), S), "split") == ["train"] * 6 + ["validation"] * 2 + ["test"] * 2
    assert sequence.temporal_folds(100, 3, 40) == [(0, 40, 60), (1, 60, 80), (2, 80, 100)] and sequence.temporal_folds(5, 3, 40) == []


def test_time_join_ties_and_ends(spark):
    rows = spark.createDataFrame([("m", 1, 100), ("m", 2, 50), ("d", 3, 100)], "k string, id long, t long")
    src = spark.createDataFrame([("m", 100, 1, 1.0), ("m", 100, 2, 2.0), ("m", 40, 0, 4.0), ("m", 101, 3, 8.0)], "k string, time_us long, seq long, v double")
    found = augment(rows, {"s": src}, ["k"], "id", "t", latest={"last": ("s", "v")}, sums={"sum": ("s", "v", 60)}, default=None)
    assert sorted((r["id"], r["last"], r["sum"]) for r in found.collect()) == [(1, 2.0, 7.0), (2, 4.0, 4.0), (3, None, 0.0)]


def test_trends_and_streaks(spark):
    rows = [(date(2026, 1, d), g, u) for d, g, u in ((1, 0.1, 0.2), (3, 0.3, 0.4), (8, 0.8, 0.9), (9, 0.5, 0.5), (10, 0.1, 0.9), (11, 0.2, 0.9))]
    df = spark.createDataFrame(rows, "day date, g double, u double")
    trend = similarity.trailing_trend(df, [], "day", "g").orderBy("day").collect()
    assert (trend[2]["g_mean_7d"], trend[2]["g_mean_30d"], trend[2]["g_delta_7d"], trend[2]["g_delta_1d"]) == (0.55, 0.4, 0.7, None)
    assert [r["streak"] for r in similarity.closer_streaks(df, [], "day", "g", "u", ("g", "u")).orderBy("day").collect()] == [1, 1, 1, 0, 1, 2]


def test_deviation_needs_history(spark):
    rows = [(date(2026, 1, 1) + timedelta(days=i), 1.0 + i % 3 * 0.1) for i in range(20)] + [(date(2026, 1, 21), 9.0)]
    found = similarity.deviations(spark.createDataFrame(rows, "day date, v double"), [], "day", "v").orderBy("day").collect()
    assert [r["z"] is None for r in found[:15]] == [True] * 14 + [False] and [r["is_anomaly"] for r in found] == [False] * 20 + [True]


def test_relations(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 2.0), ("c", 3.0, 1.0), ("d", 1.0, 1.0), ("e", 3.0, 1.0)], "id string, x double, y double")
    assert sorted(r["id"] for r in relations.pareto_front(df, "id", "x", "y").collect()) == ["a", "b", "c", "e"]
    assert {r["id"]: r["dominated_by"] for r in relations.dominated(df, "id", ["x", "y"]).collect()} == {"a": 0, "b": 0, "c": 0, "d": 4, "e": 0}
    assert [r["n"] for r in relations.scaled(df, {"x": True}).select(F.col("norm_x").alias("n")).orderBy("n").collect()] == [0, 0, 0.5, 1, 1]
    same = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None)], "g string, v string")
    assert relations.mode_of(same, ["g"], "v", "m").first()["m"] == "a"
    seen = spark.createDataFrame([("g", " z ", 1), ("g", "a", 2), ("h", " ", 1)], "g string, v string, at long")
    assert sorted(tuple(r) for r in relations.first_seen_mode(seen, ["g"], "v", "at", "m").collect()) == [("g", "z"), ("h", "")]
    with pytest.raises(ValueError):
        relations.require_unique(same, ["g"])
    pair = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 3.0), (2, "b", 2.0), (1, "c", 9.0), (2, "c", 9.0)], "u long, m string, v double")
    z = {(r["model_a"], r["model_b"]): r["z"] for r in relations.paired_differences(pair, "u", "m", "v").collect()}
    assert z["a", "b"] == float("inf") and z["a", "c"] < 0
    assert relations.evenly_spaced(spark.range(10), [F.col("id")], 3).count() == 3 and relations.evenly_spaced(spark.range(2), [F.col("id")], 3).count() == 2
    assert relations.hashed_sample(spark.range(50), "id", 5).collect() == relations.hashed_sample(spark.range(50).repartition(7), "id", 5).collect()


def test_jaccard_and_shares(spark):
    mine = spark.createDataFrame([("d", "a", 1), ("d", "b", 2)], "g string, k string, rank long")
    public = spark.createDataFrame([("a", 2), ("c", 1)], "k string, rank long")
    r = similarity.rank_weighted_jaccard(mine, public, ["g"], "k").first()
    assert r["similarity"] == round(0.5 / (1 + 0.5 + 1), 9) and r["shared"] == 1
    events = spark.createDataFrame([(1, 10.0, "x"), (2, 4.0, "y")], "e long, ms double, k string")
    tags = spark.createDataFrame([("x", "p"), ("x", "q"), ("x", "q"), ("y", "p")], "k string, tag string")
    assert sorted(tuple(r) for r in similarity.fractional_shares(events, tags, "k", "tag", "e", "ms").collect()) == [("p", 1.5, 9.0), ("q", 0.5, 5.0)]
    months = spark.createDataFrame([("1", "a", 5), ("1", "b", 5), ("2", "a", 10), ("3", "c", 1)], "m string, l string, n long")
    assert sorted(tuple(r) for r in similarity.regime_shifts(months, "m", "l", "n").collect()) == [("2", 0.5, "a", "b"), ("3", 1.0, "c", "a")]


def test_graph(spark):
    e = spark.createDataFrame([("s", i, x) for i, x in enumerate("abbac")], "s string, i long, n string")
    assert {(r["source"], r["target"]): r["n"] for r in graph.transitions(e, ["s"], ["i"], "n").collect()} == {("a", "b"): 1, ("b", "a"): 1, ("a", "c"): 1}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "id long, v array<double>")
    assert [(r["query"], r["neighbour"]) for r in graph.top_neighbours(v, "id", "v", v.where("id = 1"), 1).collect()] == [(1, 2)]


def test_metrics(spark):
    p = spark.createDataFrame([(1, [0.7, 0.2, 0.1], 0), (2, [0.1, 0.6, 0.3], 2), (3, [0.4, 0.4, 0.2], 1)], "id long, p array<double>, y int")
    r = metrics.with_rank(p, "p", "y")
    assert [x["rank_true"] for x in r.orderBy("id").collect()] == [1, 2, 2]
    m = metrics.ranking_metrics(r, 2, "p", 3).first()
    assert m["hit"] == 1.0 and m["mrr"] == round(2 / 3, 9)
    assert metrics.conformal_threshold(r, 0.5).first()["threshold"] == 0.6
    assert metrics.prediction_sets(r, "p", 0.5).first()["coverage"] == round(1 / 3, 9)
    d = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "s string, v string")
    assert metrics.js_divergence(d, "s", "a", "a", "v").first()["divergence"] == 0.0
    assert 0.3 < metrics.js_divergence(d, "s", "a", "b", "v").first()["divergence"] < 0.32
    assert sorted(x["bin"] for x in metrics.histogram_bins(spark.range(5).withColumn("z", F.col("id").cast("double")), "z", 4).collect()) == [1, 2, 3, 4, 4]


def test_retrieval(spark):
    b = spark.createDataFrame([(s, i) for s, items in ((1, "abc"), (2, "ab"), (3, "bd")) for i in items], "s long, i string")
    near = {(r["item"], r["neighbour"]): r["score"] for r in retrieval.item_neighbours(b, "s", "i", 5).collect()}
    assert near["a", "b"] == round(2 / 6**0.5, 9)
    assert [r["i"] for r in retrieval.popularity(b, "s", "i", 2).orderBy("place").collect()] == ["b", "a"]
    w = {(r["item"], r["neighbour"]): r["weight"] for r in retrieval.linear_autoencoder(b, "s", "i", penalty=1.0).collect()}
    assert w["a", "b"] > 0 and ("a", "a") not in w
    with pytest.raises(ValueError):
        retrieval.linear_autoencoder(b, "s", "i", most_items=2)
    assert sorted((r["s"], r["i"]) for r in retrieval.supported(b, "s", "i", 2, 2).collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    had = {(r["s"], r["i"]) for r in b.collect()}
    assert all((r["s"], r["negative"]) not in had for r in retrieval.negative_samples(b, "s", "i", b, 4).collect())
    rng_ = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.sin(x * (F.col("id") + 1) * 0.37)).alias("v"))
    near = spark.range(300, 340).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.sin(x * (F.col("id") - 299) * 0.37) * 1.01).alias("v"))
    codes = retrieval.sign_codes(rng_.unionByName(near), "id", "v", 8, 6)
    hits = {(r["query"], r["candidate"]) for r in retrieval.lsh_candidates(codes, "id", codes.where("id >= 300"), 6).collect()}
    assert all((300 + i, i) in hits for i in range(40))  # same directions always share the bucket


def test_degrees_and_entropy_of_all_nodes(spark):
    e = spark.createDataFrame([("s", i, x) for i, x in enumerate("abaabc")] + [("t", 0, "d")], "s string, i long, x string")
    found = graph.degree_profile(graph.transitions(e, ["s"], ["i"], "x", allow_same=True), e, "x").collect()
    entropy = lambda *n: round(math.log(sum(n) + 4) - sum((c + 1) * math.log(c + 1) for c in n) / (sum(n) + 4), 9)
    assert {r["x"]: (r["out"], r["in"], r["targets"], r["entropy"]) for r in found} == {"a": (3, 2, 2, entropy(2, 1)), "b": (2, 2, 2, entropy(1, 1)), "c": (0, 1, 0, entropy()), "d": (0, 0, 0, entropy())}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
def test_artist_profile_has_every_artist(spark):
    from tessitura.plans import catalogue
    from tessitura.plans.history import history

    found = catalogue.QUERIES["w30_artist_profile"](spark, "/root/testdata/sf0.001").collect()
    artists = {r["artist"] for r in history(spark, "/root/testdata/sf0.001").where("artist <> ''").select("artist").distinct().collect()}
    assert len(found) == len(artists) and {r["artist"] for r in found} == artists and sum(r["out"] for r in found) == sum(r["in"] for r in found) > 0


def test_friction_is_compared_on_held_out_rows(spark):
    from tessitura.operators import learning

    rows = [(i, "train" if i < 300 else "test", float(i % 7), float(i % 3 == 0), float(i % 3 == 0 and i % 5 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, split string, hour double, offline double, skip double")
    found = learning.with_and_without(df.where("split = 'train'"), df, ["hour"], {"offline": 0.0}, "skip")
    test = found.where("split = 'test'")
    assert learning.auc(test, "score", "skip") > 0.9 > 0.7 > learning.auc(test, "baseline", "skip")
    assert all((r["delta"] > 0.3) if r["offline"] else (r["delta"] == 0) for r in found.collect()) and found.count() == 400


def test_every_positive_has_all_its_negatives(spark):
    rows = [(u, i) for u, had in enumerate((range(1), range(0, 20, 2), range(3, 19), range(19), range(20))) for i in had]
    b = spark.createDataFrame(rows, "u long, i long")
    for per in (1, 2, 4):
        found = [tuple(r) for r in retrieval.negative_samples(b, "u", "i", b, per).collect()]
        assert Counter(r[:2] for r in found) == {r: per for r in rows if r[0] != 4}  # user 4 has every item
        assert not {(u, n) for u, _, n in found} & set(rows) and {n for *_, n in found} <= set(range(20))
        assert all(len({n for *k, n in found if k == [2, i]}) == per for i in range(3, 19))  # drawn without repeats where few are left
    assert {n for u, _, n in found if u == 2} == {0, 1, 2, 19} and {n for u, _, n in found if u == 3} == {19}


def _hash_recall(spark, folder):
    from tessitura.plans import catalogue

    near = {(r["query"], r["neighbour"]) for r in catalogue.QUERIES["t9_neighbours"](spark, folder).collect()}
    found = {(r["query"], r["candidate"]) for r in catalogue.QUERIES["m24_lsh"](spark, folder).where("place <= 5").collect()}
    return len(near & found) / len(near)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test data here")
def test_hash_tables_find_the_nearest_rows(spark):
    assert _hash_recall(spark, "/root/testdata/sf0.1") >= 0.9


def test_queries_with_few_candidates_get_all_rows(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id long, v array<double>")
    asked = v.where("id < 2")
    some = spark.createDataFrame([(0, 2), (0, 3)], "query long, candidate long")
    rows = retrieval.ranked_candidates(some, v, "id", "v", asked, 2).orderBy("query", "place").collect()
    assert [(r["query"], r["candidate"]) for r in rows] == [(0, 2), (0, 3), (1, 2), (1, 3), (1, 0)]


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_session_transitions_are_whole(spark):
    from tessitura.plans import catalogue
    from tessitura.plans.history import history

    wanted, last = Counter(), {}
    for r in history(spark, str(DATA)).orderBy("user_id", "ts", "event_id").collect():
        at, artist = last.get(r["user_id"], (None, None))
        if at is not None and (r["ts"] - at).total_seconds() > 1800:
            artist = None
        if r["artist"]:
            if artist and artist != r["artist"]:
                wanted[artist, r["artist"]] += 1
            artist = r["artist"]
        last[r["user_id"]] = r["ts"], artist
    out, into = Counter(), Counter()
    for (a, b), n in wanted.items():
        out[a] += n
        into[b] += n
    found = catalogue.QUERIES["w28_w29_session_transitions"](spark, str(DATA)).collect()
    assert 1 in wanted.values() and {(r["source"], r["target"]): (r["n"], r["out_share"], r["in_share"]) for r in found} == {(a, b): (n, round(n / out[a], 9), round(n / into[b], 9)) for (a, b), n in wanted.items()}


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_every_query_with_sql_matches_it(spark):
    duckdb = pytest.importorskip("duckdb")
    from tessitura.plans import catalogue

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")

    def plain(v):
        if v is None or v != v:
            return None
        return float(f"{v:.6g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else float(v) if type(v).__name__ == "Decimal" else v

    wrong = []
    for name, sql in catalogue.ORACLE.items():
        df = catalogue.QUERIES[name](spark, str(DATA))
        wanted = con.sql(sql)
        order = sorted(df.columns)
        assert sorted(wanted.columns) == order, name
        a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
        at = [wanted.columns.index(c) for c in order]
        b = sorted((tuple(plain(r[i]) for i in at) for r in wanted.fetchall()), key=repr)
        if a != b:
            wrong.append((name, [x for x in a if x not in b][:2], [x for x in b if x not in a][:2]))
    assert not wrong

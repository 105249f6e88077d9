"""Sessions, trailing totals and top N, against plain Python on small tables."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tessitura.operators.gaptree import cartesian_forest, cartesian_tree, cut, forest_sessions, gap_forest, gap_sessions
from tessitura.operators.rolling import daily_totals, trailing_totals
from tessitura.operators.topn import top_n

EPOCH = datetime(2024, 3, 1, tzinfo=UTC)
EVENTS = "entity string, chunk string, event_id long, user_id string, ts timestamp, artist_key string, ms long"


def at(minutes: float) -> datetime:
    return EPOCH + timedelta(minutes=minutes)


def rows(seed: int, n: int = 400) -> list[tuple]:
    """Events of a few users over days, with repeats, nulls, equal times, and gaps of exactly 30 minutes."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = rng.choice(["hot"] * 4 + ["b", "c", None])
        when = None if rng.random() < 0.03 else at(rng.choice([rng.randrange(0, 6000), rng.randrange(0, 60) * 30, 1440 * rng.randrange(3)]))
        out.append(("x", "y", i, user, when, rng.choice(["k1", "k2", "k3", "", None]), rng.choice([None, -5, 0, 100, 7])))
    return out + [out[i] for i in range(0, n, 17)]


def expected(events: list[tuple], gap: int) -> list[tuple]:
    by_user = defaultdict(list)
    for _, _, i, user, when, key, _ in set(events):
        if user is not None and when is not None:
            by_user[user].append((round(when.timestamp() * 1e6), i, key))
    found = []
    for user, mine in by_user.items():
        mine.sort(key=lambda x: x[:2])
        run = []
        for e in mine:
            if run and e[0] - run[-1][0] > gap:
                found.append((user, run))
                run = []
            run.append(e)
        found.append((user, run))
    return sorted((u, r[0][0], r[-1][0], len(r), len({k for _, _, k in r if k})) for u, r in found)


def got(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("entity", "start_us", "end_us", "event_count", "key_count").collect())


def test_tree_is_a_heap_in_order():
    rng = random.Random(3)
    gaps = [rng.randrange(20) for _ in range(300)]
    left, right, top = cartesian_tree(gaps)

    def walk(i: int) -> list[int]:
        if i < 0:
            return []
        assert all(j < 0 or gaps[j] <= gaps[i] for j in (left[i], right[i]))
        return [*walk(left[i]), i, *walk(right[i])]

    assert walk(top) == list(range(300))
    for longest in (-1, 0, 5, 19, 20):
        assert cut(gaps, left, right, top, longest) == [i for i, g in enumerate(gaps) if g > longest]
    assert cartesian_tree([]) == ([], [], -1)
    starts = [0, 1, 7, 100, 299]
    whole = cartesian_forest(gaps, starts)
    for a, b, root in zip(starts, [*starts[1:], 300], whole[2]):
        one = cartesian_tree(gaps[a + 1 : b])
        assert root == (one[2] + a + 1 if one[2] >= 0 else -1)
        assert [[c - a - 1 if c >= 0 else -1 for c in side[a + 1 : b]] for side in whole[:2]] == [one[0], one[1]]


def test_crown_and_trees_are_the_tree_of_all_gaps(spark):
    """Every gap of an entity lies in exactly one node, and none has a wider gap below it."""
    events = rows(3)
    forest = gap_forest(spark.createDataFrame(events, EVENTS), "user_id", "ts", "event_id", "artist_key", most=9)
    trees = {(r["entity"], r["chunk"], r["piece"]): r for r in forest.trees.collect()}
    for crown in forest.crowns.collect():
        mine = [trees[crown["entity"], c, p] for c, p in zip(crown["chunks"], crown["pieces"])]
        times = [t for r in mine for t in r["times"]]
        assert times == sorted(times) and len(mine) > 3
        gaps = []
        for i, r in enumerate(mine):
            if i:
                gaps.append(crown["gaps"][2 * i])
            inner = [b - a for a, b in zip(r["times"], r["times"][1:])]
            assert crown["gaps"][2 * i + 1] == r["widest"] == max(inner, default=-1)
            gaps += inner
        assert gaps == [b - a for a, b in zip(times, times[1:])]
        for tree, value in [((crown["below_left"], crown["below_right"], crown["top"]), crown["gaps"]), *(((r["below_left"], r["below_right"], r["top"]), [0, *(b - a for a, b in zip(r["times"], r["times"][1:]))]) for r in mine)]:
            left, right, top = tree
            todo, seen = [top], []
            while todo:
                i = todo.pop()
                if i >= 0:
                    seen.append(i)
                    assert all(j < 0 or value[j] <= value[i] for j in (left[i], right[i]))
                    todo += [left[i], right[i]]
            assert sorted(seen) == list(range(1, len(value)))


def test_sessions_match_plain_python_for_many_gaps(spark):
    events = rows(1)
    df = spark.createDataFrame(events, EVENTS)
    gaps = [0, 1_800_000_000, 7_200_000_000, 200_000_000_000]
    found = gap_sessions(df, "user_id", "ts", "event_id", "artist_key", gaps_us=gaps).cache()
    stored = forest_sessions(gap_forest(df, "user_id", "ts", "event_id", "artist_key"), gaps).cache()
    for gap in gaps:
        assert got(found.where(F.col("gap_us") == gap)) == expected(events, gap)
        assert got(stored.where(F.col("gap_us") == gap)) == expected(events, gap)


def test_chunks_in_pieces_and_small_chunks_change_nothing(spark):
    events = rows(2)
    df = spark.createDataFrame(events, EVENTS)
    wanted = expected(events, 1_800_000_000)
    assert got(gap_sessions(df, "user_id", "ts", "event_id", "artist_key", most=7)) == wanted
    assert got(gap_sessions(df, "user_id", "ts", "event_id", "artist_key", chunk_us=600_000_000)) == wanted
    assert got(forest_sessions(gap_forest(df, "user_id", "ts", "event_id", "artist_key", most=7, chunk_us=7_200_000_000), [1_800_000_000] * 2)) == wanted


def test_keys_of_sessions(spark):
    events = rows(4, 120)
    found = gap_sessions(spark.createDataFrame(events, EVENTS), "user_id", "ts", "event_id", "artist_key", with_keys=True)
    assert all(None not in r["keys"] and "" not in r["keys"] and len(set(r["keys"])) == len(r["keys"]) for r in found.collect())
    assert got(found.withColumn("key_count", F.size("keys"))) == expected(events, 1_800_000_000)


def test_sessions_of_nothing(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert gap_sessions(empty, "user_id", "ts", "event_id", "artist_key").count() == 0
    assert forest_sessions(gap_forest(empty, "user_id", "ts", "event_id"), [5]).count() == 0
    void = spark.createDataFrame([("x", "y", 1, None, at(1), None, None), ("x", "y", 2, "u", None, None, None)], EVENTS)
    assert gap_sessions(void, "user_id", "ts", "event_id").count() == 0


def test_before_1970(spark):
    old = [("x", "y", i, "u", datetime(1969, 12, 31, 23, 50, tzinfo=UTC) + timedelta(minutes=20 * i), "k", 1) for i in range(3)]
    assert got(gap_sessions(spark.createDataFrame(old, EVENTS), "user_id", "ts", "event_id", "artist_key")) == expected(old, 1_800_000_000)


def test_trailing_totals_match_plain_python(spark):
    events = [(a, b, i, u, t + timedelta(days=(i * 7) % 90) if t else None, k, m) for a, b, i, u, t, k, m in rows(5)]
    totals = trailing_totals(daily_totals(spark.createDataFrame(events, EVENTS), "user_id", "ts", "event_id", "ms"), (2, 7))
    by = defaultdict(lambda: [0, 0])
    for _, _, _, user, when, _, ms in set(events):
        if user is not None and when is not None:
            cell = by[user, (when.date() - datetime(1970, 1, 1).date()).days]
            cell[0] += 1
            cell[1] += max(ms or 0, 0)
    wanted = {}
    for user in {u for u, _ in by}:
        days = [d for u, d in by if u == user]
        for day in range(min(days), max(days) + 1):
            wanted[user, day] = [sum(by.get((user, d), (0, 0))[i] for d in range(day - n + 1, day + 1)) for n in (2, 7) for i in (0, 1)]
    found = {(r["entity"], r["day"]): [r["plays_2"], r["amount_2"], r["plays_7"], r["amount_7"]] for r in totals.collect()}
    assert found == wanted
    one = totals.where("plays_7 > 0").first()
    assert one["plays_avg_7"] == one["plays_7"] / 7 and one["amount_avg_2"] == one["amount_2"] / 2


def test_trailing_totals_of_nothing(spark):
    assert trailing_totals(daily_totals(spark.createDataFrame([], EVENTS), "user_id", "ts", "event_id", "ms")).count() == 0


def test_null_event_ids_are_events_of_their_own(spark):
    two = [("x", "y", None, "u", at(0), None, 5)] * 2
    assert daily_totals(spark.createDataFrame(two, EVENTS), "user_id", "ts", "event_id", "ms").first()["plays"] == 2
    assert gap_sessions(spark.createDataFrame(two, EVENTS), "user_id", "ts", "event_id").first()["event_count"] == 2


TOP = "bin string, score string, fam string, s double, i long, place string"


def test_top_n_matches_plain_python(spark):
    rng = random.Random(6)
    data = []
    for i in range(600):
        fam = rng.choice(["hot"] * 5 + ["b", "c", f"f{i % 40}", None])
        data.append(("clash", "clash", fam, rng.choice([None, float("nan"), 0.0, -0.0, 1.0, round(rng.random(), 2), -3.0, float("inf")]), i if rng.random() > 0.02 else None, "p"))
    data += rng.choices(data, k=80)
    by = defaultdict(set)
    for _, _, fam, s, i, _ in data:
        if fam is not None and s is not None and s == s and i is not None:
            by[fam].add((-s, i))
    wanted = sorted((fam, i) for fam, mine in by.items() for _, i in sorted(mine)[:5])
    for parts in (1, 3, 16):
        found = top_n(spark.createDataFrame(data, TOP).repartition(parts), "fam", "s", "i", 5)
        assert sorted((r["bin"], r["id"]) for r in found.collect()) == wanted


def test_top_n_of_equal_scores_and_nothing(spark):
    same = [("", "", "f", 1.0, i, "") for i in range(3000)]
    found = top_n(spark.createDataFrame(same, TOP).repartition(8), "fam", "s", "i", 3)
    assert sorted(r["id"] for r in found.collect()) == [0, 1, 2]
    assert top_n(spark.createDataFrame([], TOP), "fam", "s", "i", 3).count() == 0


def test_top_n_shuffles_survivors_only(spark):
    data = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 700)).alias("fam"), F.pmod(F.xxhash64("id"), F.lit(9_973)).cast("double").alias("s"), F.col("id").alias("i"))
    wanted = {tuple(r) for r in data.withColumn("r", F.expr("row_number() over (partition by fam order by s desc, i)")).where("r <= 4").select("fam", "i").collect()}
    for most in (0, 3, 100_000):
        found = top_n(data.repartition(12), "fam", "s", "i", 4, most_bounds=most)
        assert {(r["bin"], r["id"]) for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan or "broadcast" in plan
    physical = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical

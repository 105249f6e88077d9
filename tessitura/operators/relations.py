"""Aggregates, ranks, joins and set operations with the tie and null rules of the listening marts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.session import materialize, release
from tessitura.sources import files


def mode_of(df: DataFrame, keys: Sequence[str], value: str, into: str) -> DataFrame:
    """The most frequent value per group, nulls left out; of equals the smallest. Counted in two steps, so no group is held at once."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))["v"]
    return counts.groupBy(*keys).agg(best.alias(into))


def first_seen_mode(df: DataFrame, keys: Sequence[str], value: str, order: str, into: str) -> DataFrame:
    """As mode_of(), over trimmed text that isn't blank; of equals the one seen first; "" for groups without any."""
    text = F.trim(F.col(value))
    counts = df.groupBy(*keys, text.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_at"))
    counts = counts.withColumn("_n", F.when(F.coalesce("_v", F.lit("")) == "", 0).otherwise(F.col("_n")))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_at").alias("at"), F.when(F.col("_n") > 0, F.col("_v")).otherwise("").alias("v")))["v"]
    return counts.groupBy(*keys).agg(best.alias(into))


def top_one(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def rank_present(df: DataFrame, keys: Sequence[str], value: str, into: str) -> DataFrame:
    """Dense rank from the largest value; null stays null."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value))
    return df.withColumn(into, F.when(F.col(value).isNotNull(), F.dense_rank().over(w)).cast("long"))


def min_max(value: str, keys: Sequence[str], higher_is_better: bool = True) -> Column:
    """0 to 1 over the group; 0.5 if it has at most one value or all are equal. Null is null. scaled() does whole tables."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    part = (F.col(value) - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(F.col(value).isNotNull(), F.coalesce(part if higher_is_better else 1 - part, F.lit(0.5)))


def scaled(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """norm_<column> of every column over the whole table, by one aggregate of bounds that is joined back as one row."""
    bounds = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    joined = df.join(F.broadcast(bounds))
    for c, up in columns.items():
        part = (F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0))
        joined = joined.withColumn(f"norm_{c}", F.when(F.col(c).isNotNull(), F.coalesce(part if up else 1 - part, F.lit(0.5))))
    return joined.drop(*(f"_{n}_{c}" for c in columns for n in ("lo", "hi")))


def mean_spread(value: str) -> list[Column]:
    """n, mean, sample deviation (0 for one row) and the half width of the 95 % interval."""
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), std.alias("std"), (1.96 * std / F.sqrt(F.count(value))).alias("ci95")]


def dominated(df: DataFrame, ident: str, high: Sequence[str], low: Sequence[str] = (), *, most: int = 20_000) -> DataFrame:
    """(ident, dominates, dominated_by): pairs in which one row is at least as good in all columns and better in one.

    For tables of candidates (models, policies): the pairs are compared in a nested loop, so more than `most` rows
    raise. pareto_front() does large tables without pairs.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows are compared with each other; use pareto_front()")
    columns = [*high, *low]
    one, other = (df.select(F.col(ident).alias(f"{p}_id"), *((-F.col(c) if c in low else F.col(c)).alias(f"{p}_{c}") for c in columns)) for p in ("a", "b"))
    reach = reduce(lambda x, y: x & y, (F.col(f"a_{c}") >= F.col(f"b_{c}") for c in columns))
    better = reduce(lambda x, y: x | y, (F.col(f"a_{c}") > F.col(f"b_{c}") for c in columns))
    pairs = one.join(other, reach & better).select("a_id", "b_id")
    wins = pairs.groupBy(F.col("a_id").alias(ident)).agg(F.count(F.lit(1)).alias("dominates"))
    losses = pairs.groupBy(F.col("b_id").alias(ident)).agg(F.count(F.lit(1)).alias("dominated_by"))
    return df.select(ident).join(wins, ident, "left").join(losses, ident, "left").fillna(0, ["dominates", "dominated_by"])


def pareto_front(df: DataFrame, ident: str, x: str, y: str) -> DataFrame:
    """Rows that no row beats in both x and y (larger is better), by one pass in order of x: no pairs are made.

    Rows are first reduced to the best y of each x. The running maximum of larger x is taken in two levels: within
    ranges of x, and over the ranges' maxima. The ranged rows are written in between, so that both see the same ranges.
    """
    best = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.max(y).alias("_y"))
    ranged = materialize(best.repartitionByRange(F.desc(x)).withColumn("_p", F.spark_partition_id()), "front")
    over = ranged.groupBy("_p").agg(F.max("_y").alias("_m"))
    before = over.withColumn("_above", F.max("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    inside = F.max("_y").over(Window.partitionBy("_p").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1))
    front = ranged.withColumn("_in", inside).join(before, "_p").where(F.col("_y") > F.coalesce(F.greatest("_in", "_above"), F.lit(float("-inf"))))
    return df.join(front.select(F.col(x).alias("_x"), "_y"), (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))).select(ident, x, y)


def paired_differences(df: DataFrame, unit: str, model: str, value: str) -> DataFrame:
    """Per pair of models that share units: n, mean difference, its standard error and z (0 error: infinite if the mean is positive, else 0)."""
    a, b = (df.select(F.col(unit).alias("_u"), F.col(model).alias(m), F.col(value).alias(v)) for m, v in (("model_a", "_a"), ("model_b", "_b")))
    d = F.col("_a") - F.col("_b")
    g = a.join(b, "_u").where("model_a < model_b").groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), (F.coalesce(F.stddev_samp(d), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("stderr"))
    return g.withColumn("z", F.when(F.col("stderr") > 0, F.col("mean_diff") / F.col("stderr")).when(F.col("mean_diff") > 0, float("inf")).otherwise(0.0))


def union_all(*frames: DataFrame) -> DataFrame:
    """By name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows repeat {keys}")
    return df


def list_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added or removed keys between two versions of a list."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def first_match(rows: DataFrame, exact: DataFrame, fallback: DataFrame, exact_key: str, fallback_keys: Sequence[str], value: str) -> DataFrame:
    """value by the exact key, else by the fallback keys."""
    joined = rows.join(exact.select(exact_key, F.col(value).alias("_x")), exact_key, "left").join(fallback.select(*fallback_keys, F.col(value).alias("_f")), list(fallback_keys), "left")
    return joined.withColumn(value, F.coalesce("_x", "_f")).drop("_x", "_f")


def in_order(df: DataFrame, order: Sequence[Column], into: str) -> DataFrame:
    """Row numbers from 0 in a global order, without one task for all: ranges are counted, then numbered from their offsets.

    The ranged rows are written to the shared folder in between, so that both passes see the same ranges.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_l", local).join(offsets, "_p").withColumn(into, (F.col("_o") + F.col("_l") - 1).cast("long")).drop("_p", "_l", "_o")


def running_totals(df: DataFrame, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """<value>_so_far of each value: its sum up to and with the row in a global order, without one task for all: ranges are added up, then continued from their offsets. The order must tell all rows apart."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_p").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_p", *(F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumns({f"{v}_so_far": F.sum(v).over(inside) for v in values}).join(offsets, "_p")
    return found.withColumns({f"{v}_so_far": F.col(f"{v}_so_far") + F.col(f"_o_{v}") for v in values}).drop("_p", *(f"_o_{v}" for v in values))


def quantiles(df: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """One row with q0, q1, ...: exact quantiles with linear interpolation, from counts of distinct values in order of range. Null and NaN are left out; an empty table gives nulls."""
    value = F.col(column).cast("double")
    counts = df.select(value.alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ranged = running_totals(counts, [F.col("v")], ["c"])
    n = ranged.agg(F.sum("c").alias("_n"))
    pick = lambda place: F.min(F.when(F.col("c_so_far") > place, F.col("v")))
    spot = [(F.col("_n") - 1) * q for q in at]
    ends = ranged.join(F.broadcast(n)).agg(*(x for i, h in enumerate(spot) for x in (pick(F.floor(h)).alias(f"lo{i}"), pick(F.ceil(h)).alias(f"hi{i}"), F.max(h - F.floor(h)).alias(f"f{i}"))))
    return ends.select(*((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}")).alias(f"q{i}") for i in range(len(at))))


def against_baseline(df: DataFrame, keys: Sequence[str], label: str, baseline: object, values: Sequence[str]) -> DataFrame:
    """Each row beside the row of its key that has the baseline's label: delta_<value>; null where the key has none."""
    base = df.where(F.col(label) == baseline).select(*keys, *(F.col(v).alias(f"_b_{v}") for v in values))
    found = df.join(base, list(keys), "left").withColumns({f"delta_{v}": F.col(v) - F.col(f"_b_{v}") for v in values})
    return found.drop(*(f"_b_{v}" for v in values))


def phase_changes(before: DataFrame, after: DataFrame, phase: str, seconds: str) -> DataFrame:
    """Phases of two runs side by side: seconds of both (0 where one lacks it), their difference, its share of the first, and how many times faster the second is."""
    joined = before.select(phase, F.col(seconds).alias("_a")).join(after.select(phase, F.col(seconds).alias("_b")), phase, "full_outer")
    a, b = (F.coalesce(c, F.lit(0.0)) for c in ("_a", "_b"))
    state = lambda c: F.when(F.col(c).isNull(), "missing").otherwise("ok")
    return joined.select(phase, state("_a").alias("baseline_status"), state("_b").alias("candidate_status"), a.alias("baseline_seconds"), b.alias("candidate_seconds"), (b - a).alias("delta_seconds"), ((b - a) / F.nullif(a, F.lit(0.0))).alias("delta_share"), (a / F.nullif(b, F.lit(0.0))).alias("speedup"))


def evenly_spaced(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """At most `most` rows at even distances in the order, first and last among them."""
    numbered = in_order(df, order, "_at")
    n = numbered.count()
    if n <= most:
        return numbered.drop("_at")
    wanted = sorted({round(i * (n - 1) / (most - 1)) for i in range(most)}) if most > 1 else [0]
    return numbered.join(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in wanted], "_at long")), "_at", "left_semi").drop("_at")


def hashed_sample(df: DataFrame, ident: str, most: int, seed: int = 0) -> DataFrame:
    """`most` rows by a hash of their id: the same ones on every run and layout."""
    return df.orderBy(F.xxhash64(F.col(ident), F.lit(seed)), ident).limit(most)


def until_stable(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeat a filter until no row goes; each round is written to the shared folder, which cuts the lineage.

    A round that changes anything takes a row away, so it ends; the rounds before are deleted.
    """
    now = materialize(df, "rounds")
    n = now.count()
    while True:
        after = materialize(step(now), "rounds")
        left = after.count()
        if left == n:
            release(after)
            return now
        release(now)
        now, n = after, left


def inbox(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Rows whose key an earlier call with this path has not seen; their keys are then known.

    The state is a Parquet folder of keys by call, and a file that names the calls that count, replaced in one step.
    """
    spark = rows.sparkSession
    text = files.read_text(spark, f"{path}/current")
    calls = json.loads(text) if text else []
    new = rows.where(F.col(key).isNotNull())
    if calls:
        new = new.join(spark.read.parquet(*(f"{path}/{c}" for c in calls)), key, "left_anti")
    found = materialize(new, "inbox")
    name = f"call-{len(calls)}-{uuid.uuid4().hex}"
    found.select(key).distinct().write.parquet(f"{path}/{name}")
    files.replace_text(spark, f"{path}/current", json.dumps([*calls, name]))
    return found

"""Ranking, drift and calibration measures over rows with an array of class probabilities."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.relations import in_order, running_totals
from tessitura.session import materialize


def softmax(scores: str | Column, temperature: float | Column = 1.0) -> Column:
    scores = F.col(scores) if isinstance(scores, str) else scores
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp((x.cast("double") - top.cast("double")) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def ranked_classes(proba: str) -> Column:
    """Class numbers from the most probable; of equals the smaller."""
    pairs = F.transform(proba, lambda p, i: F.struct((-p).alias("p"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda x: x["i"])


def with_rank(df: DataFrame, proba: str, truth: str) -> DataFrame:
    """rank_true (from 1), p_true, predicted and p_top."""
    at = F.col(truth).cast("int")
    own = F.element_at(proba, at + 1)
    better = F.size(F.filter(F.transform(proba, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: (x["p"] > own) | ((x["p"] == own) & (x["i"] < at))))
    return df.withColumn("rank_true", better + 1).withColumn("p_true", own).withColumn("predicted", F.array_position(proba, F.array_max(proba)).cast("int") - 1).withColumn("p_top", F.array_max(proba))


def ranking_metrics(ranked: DataFrame, k: int, proba: str, classes: int) -> DataFrame:
    """hit, ndcg and mrr at k with one relevant class, coverage of the classes by the lists of k, and their Gini-Simpson diversity."""
    within = F.col("rank_true") <= k
    base = ranked.agg(F.avg(within.cast("int")).alias("hit"), F.avg(F.when(within, 1 / F.log2(F.col("rank_true") + 1)).otherwise(0.0)).alias("ndcg"), F.avg(F.when(within, 1 / F.col("rank_true")).otherwise(0.0)).alias("mrr"))
    shown = ranked.select(F.explode(F.slice(ranked_classes(proba), 1, k)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    spread = shown.agg((F.count(F.lit(1)) / F.lit(classes)).alias("coverage"), F.sum("n").alias("_t"), F.sum(F.col("n") * F.col("n")).alias("_q")).select("coverage", (1 - F.col("_q") / (F.col("_t") * F.col("_t"))).alias("diversity"))
    return base.join(spread).select(*(F.round(c, 9).alias(c) for c in ("hit", "ndcg", "mrr", "coverage", "diversity")))


def calibration(ranked: DataFrame, bins: int = 15) -> DataFrame:
    """Per confidence bin of equal width: rows, accuracy, confidence, and the bin's part of the expected calibration error."""
    at = F.least(F.floor(F.col("p_top") * bins), F.lit(bins - 1)).cast("long")
    g = ranked.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rank_true") == 1).cast("int")).alias("accuracy"), F.avg("p_top").alias("confidence"))
    part = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))) * F.abs(F.col("accuracy") - F.col("confidence"))
    return g.withColumn("ece_part", part).select("bin", "n", *(F.round(c, 9).alias(c) for c in ("accuracy", "confidence", "ece_part")))


def brier(df: DataFrame, proba: str, truth: str) -> DataFrame:
    one = F.aggregate(F.transform(proba, lambda p, i: F.pow(p - F.when(i == F.col(truth), 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return df.agg(F.round(F.avg(one), 9).alias("brier"))


def temperature_search(df: DataFrame, scores: str, truth: str, temperatures: Sequence[float]) -> DataFrame:
    """(temperature, nll) of the grid: all temperatures in one pass over the rows."""
    nll = [F.avg(-F.log(F.greatest(F.element_at(softmax(scores, t), F.col(truth).cast("int") + 1), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(temperatures)]
    one = df.agg(F.array(*nll).alias("v")) if len(nll) == 1 else df.agg(*nll).select(F.array(*(F.col(str(i)) for i in range(len(nll)))).alias("v"))
    return one.select(F.posexplode("v").alias("i", "nll")).select(F.element_at(F.array(*(F.lit(float(t)) for t in temperatures)), F.col("i") + 1).alias("temperature"), F.round("nll", 9).alias("nll"))


def conformal_threshold(ranked: DataFrame, alpha: float) -> DataFrame:
    """The k-th smallest score 1 - p_true with k = ceil((n + 1)(1 - alpha)), at most n.

    The k-th value is found by counts of distinct scores in order of range, not by sorting all rows in one task. The
    ranged counts are written once: read twice from a shuffle, adaptive execution may range them differently.
    """
    counts = ranked.groupBy((1 - F.col("p_true")).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    ranged = materialize(counts.repartitionByRange("s").withColumn("_p", F.spark_partition_id()), "scores")
    total = ranged.agg(F.sum("c").alias("n")).withColumn("k", F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n")))
    before = ranged.groupBy("_p").agg(F.sum("c").alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    upto = F.sum("c").over(Window.partitionBy("_p").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_u", upto).join(before, "_p").join(F.broadcast(total)).where(F.col("_u") + F.col("_b") >= F.col("k")).agg(F.round(F.min("s"), 9).alias("threshold"), F.max("n").alias("n"))


def prediction_sets(ranked: DataFrame, proba: str, threshold: float) -> DataFrame:
    """Coverage, mean size, and shares of single and empty sets of the classes with 1 - p <= threshold."""
    size = F.size(F.filter(proba, lambda p: 1 - p <= threshold))
    r = ranked.select(size.alias("n"), (1 - F.col("p_true") <= threshold).cast("int").alias("in"))
    return r.agg(F.round(F.avg("in"), 9).alias("coverage"), F.round(F.avg("n"), 9).alias("mean_size"), F.round(F.avg((F.col("n") == 1).cast("int")), 9).alias("single"), F.round(F.avg((F.col("n") == 0).cast("int")), 9).alias("empty"))


def risk_coverage(ranked: DataFrame, bins: int = 100) -> DataFrame:
    """Per confidence level (lower edges of equal bins): coverage and error of the rows at or above it."""
    at = F.least(F.floor(F.col("p_top") * bins), F.lit(bins - 1)).cast("long")
    g = ranked.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("rank_true") != 1).cast("int")).alias("e"))
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return g.select("bin", F.round(F.sum("n").over(w) / total, 9).alias("coverage"), F.round(F.sum("e").over(w) / F.sum("n").over(w), 9).alias("risk"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_labels"))
    return counts.join(F.broadcast(total)).withColumn("weight", F.round(F.col("_all") / (F.col("_labels") * F.col("n")), 9)).drop("_all", "_labels")


def mean_differences(df: DataFrame, split: str, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    """(feature, smd): difference of means over the pooled population deviation, 0 where that is 0."""
    pick = lambda f, c, s: f(F.when(F.col(split) == s, F.col(c)))
    one = df.agg(*(x for c in columns for x in (pick(F.avg, c, a).alias(f"ma_{c}"), pick(F.avg, c, b).alias(f"mb_{c}"), pick(F.var_pop, c, a).alias(f"va_{c}"), pick(F.var_pop, c, b).alias(f"vb_{c}"))))
    row = lambda c: F.struct(F.lit(c).alias("feature"), F.round(F.coalesce((F.col(f"mb_{c}") - F.col(f"ma_{c}")) / F.nullif(F.sqrt((F.col(f"va_{c}") + F.col(f"vb_{c}")) / 2), F.lit(0.0)), F.lit(0.0)), 9).alias("smd"))
    return one.select(F.explode(F.array(*map(row, columns))).alias("r")).select("r.*")


def share_shift(df: DataFrame, split: str, a: str, b: str, segment: str) -> DataFrame:
    """(segment, share_a, share_b, shift)."""
    is_a, is_b = F.col(split) == a, F.col(split) == b
    g = df.where(is_a | is_b).groupBy(segment).agg(F.count_if(is_a).alias("x"), F.count_if(is_b).alias("y"))
    total = g.agg(F.sum("x").alias("_x"), F.sum("y").alias("_y"))
    part = lambda n: F.coalesce(F.col(n) / F.nullif(F.col(f"_{n}"), F.lit(0)), F.lit(0.0))
    g = g.join(F.broadcast(total)).withColumn("share_a", part("x")).withColumn("share_b", part("y"))
    return g.select(segment, F.round("share_a", 9).alias("share_a"), F.round("share_b", 9).alias("share_b"), F.round(F.col("share_b") - F.col("share_a"), 9).alias("shift"))


def js_divergence(df: DataFrame, split: str, a: str, b: str, value: str) -> DataFrame:
    """Jensen-Shannon divergence of the counts of `value` in two splits, base 2, and its root, the distance."""
    s = share_shift(df, split, a, b, value)
    p, q = F.col("share_a"), F.col("share_b")
    term = lambda x: F.when(x > 0, x * F.log2(x / ((p + q) / 2))).otherwise(0.0)
    js = F.greatest(F.sum(term(p) + term(q)) / 2, F.lit(0.0))
    return s.agg(F.round(js, 6).alias("divergence"), F.round(F.sqrt(js), 6).alias("distance"))


def histogram_bins(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin from 1 to bins over the column's range; the maximum lies in the last."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    at = F.floor((F.col(column) - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")) / bins, F.lit(0.0))) + 1
    return df.join(F.broadcast(ends)).withColumn("bin", F.least(F.coalesce(at, F.lit(1)), F.lit(bins)).cast("long")).drop("_lo", "_hi")


def recency_weights(df: DataFrame, time: str, half_life_days: float, least: float, most: float) -> DataFrame:
    """weight: halves with every half_life_days before the last time, within bounds, with mean 1 before the bounds."""
    last = df.agg(F.max(F.unix_micros(time)).alias("_last"))
    rows = df.join(F.broadcast(last)).withColumn("_raw", F.pow(F.lit(2.0), -((F.col("_last") - F.unix_micros(time)) / F.lit(86_400_000_000.0)) / half_life_days))
    mean = rows.agg(F.avg("_raw").alias("_mean"))
    return rows.join(F.broadcast(mean)).withColumn("weight", F.least(F.greatest(F.col("_raw") / F.col("_mean"), F.lit(least)), F.lit(most))).drop("_last", "_raw", "_mean")


# The grid of temperatures.
TEMPERATURES = sorted({0.65, 0.8, 1.0, 1.25, 1.6} | {round(0.5 * 6 ** (i / 14), 6) for i in range(15)})


def tempered(proba: str | Column, temperature: float | Column) -> Column:
    """Class probabilities at a temperature: the softmax of their logarithms over it."""
    proba = F.col(proba) if isinstance(proba, str) else proba
    return softmax(F.transform(proba, lambda p: F.log(F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0)))), temperature)


def calibration_error(df: DataFrame, proba: Column, truth: str, into: str, bins: int = 15) -> DataFrame:
    """One row: expected calibration error over bins of equal width."""
    top = F.array_max(proba)
    rows = df.select(top.alias("_c"), (F.array_position(proba, top).cast("int") - 1 == F.col(truth)).cast("int").alias("_r"))
    g = rows.groupBy(F.least(F.floor(F.col("_c") * bins), F.lit(bins - 1)).alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.avg("_r").alias("a"), F.avg("_c").alias("c"))
    return g.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias(into))


def guarded_temperature(df: DataFrame, proba: str, truth: str, temperatures: Sequence[float] = tuple(TEMPERATURES)) -> DataFrame:
    """One row: the temperature with the least mean negative log-likelihood (of equals the smallest), whether it is accepted,
    which it is unless the calibration error rises, and that error without and with it. All temperatures in one pass."""
    own = F.col(truth).cast("int") + 1
    nll = [F.avg(-F.log(F.greatest(F.element_at(tempered(proba, t), own), F.lit(1e-12)))) for t in temperatures]
    losses = df.agg(*(F.round(x, 12).alias(f"_l{i}") for i, x in enumerate(nll)))
    best = F.array_min(F.array(*(F.struct(F.col(f"_l{i}").alias("l"), F.lit(float(t)).alias("t")) for i, t in enumerate(temperatures))))
    chosen = losses.select(best["t"].alias("candidate_temperature"))
    both = chosen.join(calibration_error(df, F.col(proba), truth, "raw_ece")).join(calibration_error(df.join(F.broadcast(chosen)), tempered(proba, F.col("candidate_temperature")), truth, "calibrated_ece"))
    accepted = F.col("calibrated_ece") <= F.col("raw_ece") + 1e-12
    return both.withColumns({"accepted": accepted, "temperature": F.when(accepted, F.col("candidate_temperature")).otherwise(1.0)})


def abstention_threshold(ranked: DataFrame, ident: str, base: float, *, target_risk: float = 0.5, least_accepted: float = 0.1, least_drop: float = 0.02) -> DataFrame:
    """One row: the confidence from which predictions are accepted.

    Rows in order of falling confidence: of those that accept at least least_accepted of all rows, the last at which the
    share of errors is at most target_risk; else the one with the best trade of risk saved against rows refused, if it
    saves least_drop. Never below `base`, which it is where none qualifies. Running shares come from ranges of the order.
    """
    rows = ranked.select(F.col("p_top").alias("c"), F.col(ident).alias("i"), (F.col("rank_true") != 1).cast("long").alias("e"), F.lit(1).cast("long").alias("one"))
    run = running_totals(rows, [F.desc("c"), F.col("i")], ["e", "one"]).select("c", F.col("one_so_far").alias("k"), (F.col("e_so_far") / F.col("one_so_far")).alias("risk"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("full"))
    accepted = run.join(F.broadcast(total)).withColumn("share", F.col("k") / F.col("n")).where(F.col("share") >= least_accepted)
    gain = F.col("full") - F.col("risk")
    trade = F.struct(F.round(gain - 0.2 * (1 - F.col("share")), 12).alias("u"), (-F.col("k")).alias("k"))
    found = accepted.agg(F.max_by("c", F.when(F.col("risk") <= target_risk, F.col("k"))).alias("met"), F.max_by("c", trade).alias("traded"), F.max_by(gain, trade).alias("saved"))
    cut = F.coalesce("met", F.when(F.col("saved") >= least_drop, F.col("traded")), F.lit(base))
    return found.select(F.round(F.greatest(cut, F.lit(base)), 9).alias("threshold"))


def blended(models: Sequence[str], weights: Sequence[float]) -> Column:
    """Class probabilities of several models, weighted."""
    total = sum(weights)
    found = F.transform(models[0], partial(_times, weights[0] / total))
    for m, w in zip(models[1:], weights[1:]):
        found = F.zip_with(found, F.transform(m, partial(_times, w / total)), lambda a, b: a + b)
    return found


def _times(by: float | Column, x: Column) -> Column:
    return x * by


def _ahead(own: Column, at: Column, x: Column) -> Column:
    return (x["p"] > own) | ((x["p"] == own) & (x["i"] < at))


def ensemble_scores(df: DataFrame, truth: str, options: dict[str, dict[str, float]], k: int = 5) -> DataFrame:
    """Per option (weights by model): top-1 accuracy, ndcg at k and mean negative log-likelihood of the blend, and whether it is the best by these in turn. All options in one pass."""
    at = F.col(truth).cast("int")
    columns = []
    for name, weights in options.items():
        proba = F.transform(blended(list(weights), list(weights.values())), lambda p: F.round(p, 12))
        own = F.element_at(proba, at + 1)
        rank = 1 + F.size(F.filter(F.transform(proba, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), partial(_ahead, own, at)))
        columns.append(F.struct(F.lit(name).alias("option"), rank.alias("rank"), own.alias("own")))
    rows = df.select(F.explode(F.array(*columns)).alias("o")).select("o.*")
    ndcg = F.avg(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    found = rows.groupBy("option").agg(F.round(F.avg((F.col("rank") == 1).cast("int")), 9).alias("top1"), F.round(ndcg, 9).alias("ndcg"), F.round(F.avg(-F.log(F.greatest("own", F.lit(1e-12)))), 9).alias("nll"))
    best = found.agg(F.min_by("option", F.struct(-F.col("top1"), -F.col("ndcg"), F.col("nll"), F.col("option"))).alias("_best"))
    return found.join(F.broadcast(best)).withColumn("best", F.col("option") == F.col("_best")).drop("_best")


def _distance(mean: Column, x: Column) -> Column:
    return (x - mean) * (x - mean)


def perturbation_importance(rows: DataFrame, ident: str, features: Sequence[str], score: str, truth: str, repeats: int = 3) -> DataFrame:
    """(feature, permutation, deviation, ablation): how much accuracy falls when a feature's values are exchanged between rows, its
    deviation over the repeats, and when they are all its mean.

    score: SQL over the features that predicts `truth`. Exchanges are shifts in the order of ident by a share of all rows,
    so that they are the same on every run: one numbering and one join per repeat, for all features.
    """
    numbered = materialize(in_order(rows.select(ident, *features, F.col(truth).alias("_y")), [F.col(ident)], "_at"), "numbered")
    n = numbered.count()
    means = numbered.agg(*(F.avg(f).alias(f"_m_{f}") for f in features))
    right = lambda changed: F.avg((F.expr(changed) == F.col("_y")).cast("int"))

    def swap(feature: str, by: str) -> str:
        return re.sub(rf"\b{feature}\b", f"`{by}{feature}`", score)

    whole = numbered.join(F.broadcast(means)).agg(right(score).alias("_base"), *(right(swap(f, "_m_")).alias(f"_a_{f}") for f in features))
    for r in range(1, repeats + 1):
        other = numbered.select(F.pmod(F.col("_at") + F.lit(r * n // (repeats + 1) + 1), F.lit(max(n, 1))).alias("_at"), *(F.col(f).alias(f"_o_{f}") for f in features))
        whole = whole.join(numbered.join(other, "_at").agg(*(right(swap(f, "_o_")).alias(f"_p{r}_{f}") for f in features)))
    made = []
    for f in features:
        drops = F.array(*(F.col("_base") - F.col(f"_p{r}_{f}") for r in range(1, repeats + 1)))
        mean = F.aggregate(drops, F.lit(0.0), lambda s, x: s + x) / repeats
        squares = F.transform(drops, partial(_distance, mean))
        spread = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / repeats)
        made.append(F.struct(F.lit(f).alias("feature"), F.round(mean, 9).alias("permutation"), F.round(spread, 9).alias("deviation"), F.round(F.col("_base") - F.col(f"_a_{f}"), 9).alias("ablation")))
    return whole.select(F.explode(F.array(*made)).alias("r")).select("r.*")

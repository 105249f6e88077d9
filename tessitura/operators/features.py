"""Features of item sequences and of candidates, over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def sequence_features(df: DataFrame, sequence: str) -> DataFrame:
    """Of each non-empty array of numbers: last, one before, first, mean, population deviation, share of different ones, length of
    the run at the end, whether the last repeats the one before, and share of different ones among the last five. Arrays with nulls or without entries are left out."""
    rows = df.where(F.size(sequence) > 0).where(~F.exists(sequence, lambda x: x.isNull()))
    s, n = F.col(sequence), F.size(sequence)
    numbers = F.transform(s, lambda x: x.cast("double"))
    mean = _sum(numbers) / n
    back = F.reverse(s)
    breaks = F.filter(F.transform(back, lambda x, i: F.when(x != F.element_at(s, -1), i)), lambda x: x.isNotNull())
    recent = F.slice(back, 1, 5)
    made = {
        "last": F.element_at(s, -1), "previous": F.element_at(s, -F.least(n, F.lit(2))), "first": F.element_at(s, 1), "mean": mean, "deviation": F.sqrt(_sum(F.transform(numbers, lambda x: x * x)) / n - mean * mean + F.lit(0.0)),
        "unique_ratio": F.size(F.array_distinct(s)) / n, "end_run": F.coalesce(F.element_at(F.concat(breaks, F.array(F.lit(None).cast("int"))), 1), n), "repeats": F.when(n > 1, (F.element_at(s, -1) == F.element_at(s, -F.least(n, F.lit(2)))).cast("int")).otherwise(1),
        "recent_unique_ratio": F.size(F.array_distinct(recent)) / F.size(recent),
    }
    made["deviation"] = F.sqrt(F.greatest(_sum(F.transform(numbers, lambda x: (x - mean) * (x - mean))) / n, F.lit(0.0)))
    return rows.withColumns(made)


def context_features(df: DataFrame, history: str, gaps: str, position: str) -> DataFrame:
    """Eight features of a history of items with the gaps between them: length, shares of different and repeated items, position in the session, mean, largest and last gap; logarithms of 1 + x."""
    n, positive = F.size(history), F.filter(gaps, lambda g: g > 0)
    unique = _share(F.size(F.array_distinct(history)).cast("double"), n)
    return df.withColumns(
        {
            "log_history": F.log1p(n.cast("double")), "unique_ratio": unique, "repeat_ratio": F.when(n > 0, 1 - unique).otherwise(0.0), "log_position": F.log1p(F.greatest(F.col(position), F.lit(0)).cast("double")),
            "log_mean_gap": F.log1p(_share(_sum(positive), F.size(positive))), "log_longest_gap": F.log1p(F.coalesce(F.array_max(positive), F.lit(0.0))), "log_last_gap": F.log1p(F.greatest(F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), gaps), -1), F.lit(0.0)), F.lit(0.0))),
        }
    )


def candidate_features(df: DataFrame, history: str, candidate: str) -> DataFrame:
    """Of a candidate against a history: its share of it, whether it is in it, is its last, is in the last three and five, and one over how far back it last stood."""
    n, c = F.size(history), F.col(candidate)
    hits = F.size(F.filter(history, lambda x: x == c))
    back = F.reverse(history)
    within = lambda k: F.array_contains(F.slice(back, 1, k), c).cast("int")
    place = F.array_position(back, c)
    return df.withColumns({"occurrence_share": _share(hits.cast("double"), n), "in_history": (hits > 0).cast("int"), "is_last": within(1), "in_last_3": within(3), "in_last_5": within(5), "recency": F.when(place > 0, 1 / place).otherwise(0.0)})


def pretraining_pairs(df: DataFrame, sequence: str, objective: str, width: int) -> DataFrame:
    """(left, right) pairs of items of each sequence. masked_tail: items of the `width` before the last with the last; neighbours: the
    same pairs both ways; contrastive: all different items of the sequence with each other, both ways."""
    tail, s = F.element_at(sequence, -1), F.col(sequence)
    context = F.array_distinct(F.slice(F.slice(F.reverse(s), 2, F.size(s)), 1, width))
    others = F.filter(context, lambda x: x != tail)
    pair = lambda a, b: F.struct(a.alias("left"), b.alias("right"))
    to_tail = F.transform(others, lambda x: pair(x, tail))
    if objective == "contrastive":
        unique = F.array_distinct(s)
        pairs = F.flatten(F.transform(unique, lambda x: F.transform(F.filter(unique, lambda y: y != x), lambda y: pair(x, y))))
    else:
        pairs = to_tail if objective == "masked_tail" else F.concat(to_tail, F.transform(others, lambda x: pair(tail, x)))
    return df.where(F.size(sequence) >= 2).select(F.explode(pairs).alias("p")).select("p.*")


def session_vectors(items: DataFrame, session: str, position: str, vector: str) -> DataFrame:
    """Per session the mean of its items' vectors, weighted from 1 for the first to 2 for the last in even steps: added up dimension by dimension, so that no session is held at once."""
    last = items.groupBy(session).agg(F.max(position).alias("_last"))
    weight = 1 + F.coalesce(F.col(position) / F.nullif(F.col("_last"), F.lit(0)), F.lit(0.0))
    cells = items.join(last, session).withColumn("_w", weight).select(session, "_w", F.posexplode(vector).alias("_i", "_x"))
    sums = cells.groupBy(session, "_i").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    return sums.groupBy(session).agg(F.transform(ordered, lambda c: c["_x"]).alias("vector"))

"""Items that occur together: counts of pairs in baskets, their ratio to chance and log-likelihood ratio."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.operators.stripes import numbered, pair_counts
from tessitura.session import materialize

def _x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Of the two-by-two table of baskets with and without each item."""
    with_a, with_b, both, all_of = (c.cast("double") for c in (n_a, n_b, n_ab, n))
    cells = _x_log_x(both) + _x_log_x(with_a - both) + _x_log_x(with_b - both) + _x_log_x(all_of - with_a - with_b + both)
    edges = _x_log_x(with_a) + _x_log_x(all_of - with_a) + _x_log_x(with_b) + _x_log_x(all_of - with_b)
    return F.greatest(F.lit(0.0), 2.0 * (cells - edges + _x_log_x(all_of)))


def cooccurrence(baskets: DataFrame, *, min_count: int = 5, min_ratio: float = 5, min_llr: float = 0.0) -> DataFrame:
    """Pairs of items that share at least min_count baskets of a kind, min_ratio times as many as by chance.

    baskets: kind string, items array<string>, one row per basket. Result: kind, item_a, item_b (item_a <
    item_b in byte order), n_ab, n_a, n_b, n (baskets of the kind with an item), ratio = n_ab * n / (n_a * n_b), llr.

    Each task merges the stripes (item -> neighbours with counts) of its baskets before they are shuffled by item; the
    arrays that meet there are added up, then counts, ratio and log-likelihood ratio decide. Exact at any size:
    - an item in more than n / min_ratio baskets can be in no such pair (n_ab is at most the smaller of n_a and n_b)
      and is left out before pairs are made. At most min_ratio times the mean basket size are so frequent: that list
      is sent to the tasks; so is that of the items in over 1 of 200 baskets (200 times the mean basket size at most),
      whose arrays are merged in blocks: 16 and more, by their share of the baskets;
    - a basket of very many pairs is worked on in slices in different tasks (stripes.PAIRS_AT_ONCE).

    A null or empty array is no basket; null items are left out; an item counts once per basket; a null kind is left
    out; an empty table gives no rows.
    """
    clean = baskets.where("kind is not null").select("kind", F.array_distinct(F.filter("items", lambda x: x.isNotNull())).alias("items"))
    kept = materialize(clean.where("size(items) > 0"), "baskets")
    totals = kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    counted = kept.select("kind", F.explode("items").alias("item")).groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n_item")).join(totals, "kind")
    ratio = F.lit(Decimal(str(min_ratio)))
    too_many = F.col("n_item") * ratio > F.col("n")
    blocks = F.least(F.ceil(F.log2(F.col("n_item") * F.lit(200.0) / F.col("n"))), F.lit(12)).cast("int") + 3
    counted = counted.withColumn("bits", F.when(too_many, -1).when(F.col("n_item") * F.lit(200) > F.col("n"), blocks).otherwise(0))
    items, seed = numbered(counted, "kind", "item")
    number = F.transform("items", lambda x: F.xxhash64("kind", x, F.lit(seed))).alias("numbers")
    pairs = pair_counts(kept.select(number), "numbers", min_count, items.where("bits <> 0").select("number", "bits"))
    side = lambda at, n_at, *more: items.select(F.col("number").alias(at), *more, F.col("item").alias(f"item_{at}"), F.col("n_item").alias(n_at))
    found = pairs.join(side("low", "n_low", "kind", "n"), "low").join(side("high", "n_high"), "high")
    first = F.col("item_low") < F.col("item_high")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    found = found.select("kind", pick("item_low", "item_high").alias("item_a"), pick("item_high", "item_low").alias("item_b"), "n_ab", pick("n_low", "n_high").alias("n_a"), pick("n_high", "n_low").alias("n_b"), "n")
    enough = F.col("n_ab").cast("decimal(19,0)") * F.col("n") >= F.col("n_a").cast("decimal(12,0)") * F.col("n_b").cast("decimal(12,0)") * ratio
    found = found.where(enough).withColumn("ratio", F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
    return found.withColumn("llr", log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n"))).where(F.col("llr") >= min_llr)

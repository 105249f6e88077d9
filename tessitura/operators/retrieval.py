"""Candidates for the next item: popularity, co-occurrence, linear autoencoder, neighbours, hashes; and their measures."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators import stripes
from tessitura.operators.graph import dot, top_neighbours
from tessitura.operators.relations import in_order, until_stable
from tessitura.session import materialize


class Retriever(Protocol):
    """What finds candidates: fit() on interactions, then candidates() as (query, item, place) for the histories (query, item) given."""

    def fit(self, interactions: DataFrame) -> Retriever: ...

    def candidates(self, histories: DataFrame, k: int) -> DataFrame: ...


class NeighbourRetriever:
    """Candidates by the sum of item_neighbours() scores of a history's items, those in it left out; ties by item."""

    def __init__(self, session: str, item: str, width: int = 20, shrink: float = 1.0) -> None:
        self.session, self.item, self.width, self.shrink = session, item, width, shrink

    def fit(self, interactions: DataFrame) -> NeighbourRetriever:
        self.near = materialize(item_neighbours(interactions, self.session, self.item, self.width, self.shrink), "near")
        return self

    def candidates(self, histories: DataFrame, k: int) -> DataFrame:
        had = histories.select(F.col(self.session).alias("query"), F.col(self.item).alias("item")).distinct()
        votes = had.join(self.near, "item").groupBy("query", F.col("neighbour").alias("candidate")).agg(F.round(F.sum("score"), 9).alias("score"))
        new = votes.join(had.withColumnRenamed("item", "candidate"), ["query", "candidate"], "left_anti")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate")).cast("long")
        return new.withColumn("place", place).where(F.col("place") <= k).withColumnRenamed("candidate", "item")


def evaluate_retriever(retriever: Retriever, histories: DataFrame, truths: DataFrame, session: str, item: str, k: int, catalogue: DataFrame) -> DataFrame:
    """One row: recall at k of a fitted retriever on held-out items, and diagnostics of its candidates."""
    found = materialize(retriever.candidates(histories, k).withColumnsRenamed({"query": session, "item": item}), "candidates")
    return recall_at(found, truths, session, item, "place", [k]).select("recall").join(candidate_diagnostics(found, truths, session, item, catalogue))


def popularity(interactions: DataFrame, session: str, item: str, k: int) -> DataFrame:
    """(item, n, place) by number of sessions; of equals the smaller item."""
    n = interactions.select(session, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), item).limit(k).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), item)).cast("long"))


def item_neighbours(interactions: DataFrame, session: str, item: str, k: int, shrink: float = 0.0) -> DataFrame:
    """(item, neighbour, score, place): sessions with both over the root of the product of their numbers plus shrink; k best of each item.

    Pairs are counted by stripes, so that none is shuffled by itself; the arrays of items in over 1 of 200 sessions are
    merged in blocks.
    """
    once = interactions.select(F.col(session).alias("_s"), F.col(item).alias("item")).where("_s is not null and item is not null").distinct()
    items, seed = stripes.numbered(once.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item")
    baskets = once.groupBy("_s").agg(F.collect_list(F.xxhash64("item", F.lit(seed))).alias("numbers"))
    sessions = once.agg(F.count_distinct("_s").alias("_all"))
    bits = (F.least(F.ceil(F.log2(F.col("n") * F.lit(200.0) / F.col("_all"))), F.lit(12)) + 3).cast("int")
    often = items.join(F.broadcast(sessions)).where(F.col("n") * 200 > F.col("_all")).select("number", bits.alias("bits"))
    counts = stripes.pair_counts(baskets, "numbers", 1, often)
    side = lambda at, name, n: items.select(F.col("number").alias(at), F.col("item").alias(name), F.col("n").alias(n))
    named = counts.join(side("low", "a", "na"), "low").join(side("high", "b", "nb"), "high")
    ends = F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("item"), F.col("a").alias("neighbour")))
    score = F.round(F.col("n_ab") / (F.sqrt(F.col("na").cast("double") * F.col("nb")) + shrink), 9)
    scored = named.select(F.explode(ends).alias("e"), score.alias("score")).select("e.item", "e.neighbour", "score")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "neighbour")).cast("long")).where(F.col("place") <= k)


def linear_autoencoder(interactions: DataFrame, session: str, item: str, *, penalty: float = 10.0, most_items: int = 2_000) -> DataFrame:
    """(item, neighbour, weight): closed-form item weights without self-weights, from the inverse of the items' Gram matrix.

    The Gram matrix is counted in Spark and inverted on the driver: at most most_items items are allowed, more raise.
    """
    once = interactions.select(F.col(session).alias("_s"), F.col(item).alias("item")).where("_s is not null and item is not null").distinct()
    listed = once.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy("item").limit(most_items + 1).collect()
    if len(listed) > most_items:
        raise ValueError(f"over {most_items} items")
    names = [r["item"] for r in listed]
    known = interactions.sparkSession.createDataFrame([(i, x) for i, x in enumerate(names)], f"number long, item {dict(interactions.dtypes)[item]}")
    baskets = once.join(F.broadcast(known), "item").groupBy("_s").agg(F.collect_list("number").alias("numbers"))
    gram = np.diag(np.array([r["n"] for r in listed], float)) if names else np.zeros((0, 0))
    counts = stripes.pair_counts(baskets, "numbers").toArrow()
    low, high = counts["low"].to_numpy(), counts["high"].to_numpy()
    gram[low, high] = gram[high, low] = counts["n_ab"].to_numpy()
    inverse = np.linalg.inv(gram + penalty * np.eye(len(names)))
    weights = -inverse / np.diag(inverse)
    np.fill_diagonal(weights, 0.0)
    rows = [(names[i], names[j], float(weights[i, j])) for i in range(len(names)) for j in range(len(names)) if i != j]
    kind = dict(interactions.dtypes)[item]
    return interactions.sparkSession.createDataFrame(rows, f"item {kind}, neighbour {kind}, weight double")


def supported(interactions: DataFrame, user: str, item: str, least_items: int, least_users: int) -> DataFrame:
    """What is left when users with few items and items with few users are taken out until none remain."""

    def step(df: DataFrame) -> DataFrame:
        users = df.groupBy(user).agg(F.count_distinct(item).alias("_n")).where(F.col("_n") >= least_items).select(user)
        kept = df.join(users, user, "left_semi")
        items = kept.groupBy(item).agg(F.count_distinct(user).alias("_n")).where(F.col("_n") >= least_users).select(item)
        return kept.join(items, item, "left_semi")

    return until_stable(interactions.select(user, item), step)


def negative_samples(positives: DataFrame, user: str, item: str, items: DataFrame, per_positive: int, seed: int = 0) -> DataFrame:
    """(user, item, negative): per_positive items that the user has not had for each positive, drawn by hash: the same on every run.

    The r-th of the items a user lacks is drawn, so that no draw is lost: its position in the numbered item list is r and
    the number of the user's own items before it, which one window over the user's items and draws counts. Draws of a
    positive may be equal; of users with half of the items or more they differ, if enough are left. Users with all have none.
    """
    numbered = in_order(items.select(F.col(item).alias("negative")).distinct(), [F.col("negative")], "_i")
    n = numbered.count()
    pairs = positives.select(user, item).distinct()
    had = pairs.select(user, F.col(item).alias("negative")).join(numbered, "negative")
    # the j-th own item, at position p, lies before the r-th lacking item if p - j <= r
    own = had.select(user, (F.col("_i") - F.row_number().over(Window.partitionBy(user).orderBy("_i")) + 1).alias("_r"))
    lacks = F.lit(n) - F.coalesce("_own", F.lit(0))
    left = pairs.join(own.groupBy(user).agg(F.count(F.lit(1)).alias("_own")), user, "left").withColumn("_lacks", lacks.cast("long")).where("_lacks > 0")
    differ = (F.col("_lacks") * 2 <= n) & (F.col("_lacks") >= per_positive)
    drawn = lambda k: F.pmod(F.xxhash64(user, item, k, F.lit(seed)), F.col("_lacks") - F.when(differ, k).otherwise(0))
    past = lambda done, r: F.aggregate(done, r, lambda x, c: F.when(c <= x, x + 1).otherwise(x))
    more = lambda done, k: F.array_sort(F.concat(done, F.array(F.when(differ, past(done, drawn(k))).otherwise(drawn(k)))))
    ranks = F.aggregate(F.sequence(F.lit(0), F.lit(per_positive - 1)), F.array().cast("array<bigint>"), more)
    draws = left.select(user, item, F.explode(ranks).alias("_r"), F.lit(True).alias("_draw"))
    both = draws.unionByName(own.withColumn("_draw", F.lit(False)), allowMissingColumns=True)
    before = F.sum(F.when(F.col("_draw"), 0).otherwise(1)).over(Window.partitionBy(user).orderBy("_r").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("_i", F.col("_r") + before).where("_draw").join(numbered, "_i").select(user, item, "negative")


def reciprocal_fusion(pools: Sequence[DataFrame], query: str, item: str, place: str, k: int, constant: int = 60) -> DataFrame:
    """(query, item, score, place): sum over pools of 1 / (constant + place), k best of each query."""
    parts = [p.select(query, item, (1 / (F.col(place) + constant)).alias("_s")) for p in pools]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy(query, item).agg(F.round(F.sum("_s"), 12).alias("score"))
    return fused.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item)).cast("long")).where(F.col("place") <= k)


def recall_at(found: DataFrame, relevant: DataFrame, query: str, item: str, place: str, ks: Sequence[int]) -> DataFrame:
    """(k, recall): mean share of a query's relevant items among its first k."""
    rel = relevant.select(query, item).distinct()
    hit = rel.join(found.select(query, item, place), [query, item], "left")
    per = hit.groupBy(query).agg(*(F.avg((F.coalesce(F.col(place), F.lit(1 << 30)) <= k).cast("int")).alias(str(k)) for k in ks))
    one = per.agg(*(F.round(F.avg(str(k)), 9).alias(str(k)) for k in ks))
    return one.unpivot([], [str(k) for k in ks], "k", "recall").select(F.col("k").cast("long").alias("k"), "recall")


def candidate_diagnostics(found: DataFrame, asked: DataFrame, query: str, item: str, catalogue: DataFrame) -> DataFrame:
    """One row over the queries asked: their number, mean, least and most candidates (0 for a query without any), and the share of the catalogue that is a candidate of some query."""
    per = asked.select(query).distinct().join(found.groupBy(query).agg(F.count(item).alias("_n")), query, "left").fillna(0, ["_n"])
    depth = per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("_n"), 9).alias("mean_candidates"), F.min("_n").alias("least_candidates"), F.max("_n").alias("most_candidates"))
    seen = catalogue.select(item).distinct().join(found.select(item).distinct().withColumn("_hit", F.lit(1)), item, "left")
    return depth.join(seen.agg(F.round(F.avg(F.coalesce("_hit", F.lit(0))), 9).alias("catalogue_coverage")))


def sign_codes(vectors: DataFrame, ident: str, vector: str, dims: int, bits: int, seed: int = 0) -> DataFrame:
    """(id, code): the side of `bits` random planes on which each vector lies; codes of close vectors agree in most bits."""
    planes = np.random.default_rng(seed).standard_normal((bits, dims))
    code = F.lit(0).cast("long")
    for b in range(bits):
        plane = F.array(*(F.lit(float(x)) for x in planes[b]))
        dot = F.aggregate(F.zip_with(vector, plane, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        code = code + F.when(dot > 0, F.lit(1 << b)).otherwise(F.lit(0))
    return vectors.select(F.col(ident), code.alias("code"))


def sign_tables(vectors: DataFrame, ident: str, vector: str, dims: int, bits: int, tables: int, seed: int = 0) -> DataFrame:
    """(id, table, code): codes as of sign_codes in several hash tables, table t with the planes of seed + t. One matrix product a batch; null ids and vectors have no code."""
    planes = np.vstack([np.random.default_rng(seed + t).standard_normal((bits, dims)) for t in range(tables)])
    powers = 1 << np.arange(bits, dtype=np.int64)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = np.stack(batch["v"].to_numpy(zero_copy_only=False)) @ planes.T > 0
                code = sides.reshape(-1, bits) @ powers
                ids = batch["i"].take(pa.array(np.repeat(np.arange(batch.num_rows), tables)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), pa.array(code)], [ident, "table", "code"])

    rows = vectors.select(F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v")).where("i is not null and v is not null")
    return rows.mapInArrow(coded, f"`{ident}` {dict(vectors.dtypes)[ident]}, table int, code long")


def hash_index(vectors: DataFrame, ident: str, vector: str, dims: int, asked: DataFrame, k: int, *, target: float = 0.9, most_asked: int = 50, seed: int = 0) -> tuple[int, int, float]:
    """(bits, tables, recall): the cheapest hash index that finds `target` of the k nearest rows, measured against brute force.

    Codes start with as many bits as leave about eight rows a bucket, so that candidates grow with the rows and not with
    their square; 16 to 64 tables are tried, then two bits less, down to 8 (below which a query probes most rows anyway:
    the last try is taken, whatever its recall, which is told). Recall is measured on at most most_asked of the rows asked,
    by a hash of their id, against all rows; this bound is a parameter and only fits the index, which then holds every row.
    """
    n = vectors.count()
    sample = materialize(asked.orderBy(F.xxhash64(ident, F.lit(5)), ident).limit(most_asked), "asked")
    near = materialize(top_neighbours(vectors, ident, vector, sample, k).select("query", F.col("neighbour").alias("candidate")), "near")
    truth = near.count()
    bits, found = max(8, int(math.log2(max(n, 1))) - 3), (8, 32, 1.0)
    while truth:
        codes = materialize(sign_tables(vectors, ident, vector, dims, bits, 64, seed), "codes")
        probes = lsh_candidates(codes, ident, codes.join(sample.select(ident), ident, "left_semi"), bits, first_table=True)
        met = near.join(probes, ["query", "candidate"], "left").agg(*(F.avg((F.coalesce("table", F.lit(64)) < t).cast("int")).alias(str(t)) for t in (16, 32, 64))).first()
        for tables in (16, 32, 64):
            found = bits, tables, met[str(tables)]
            if found[2] >= target:
                return found
        if bits <= 8:
            break
        bits = max(8, bits - 2)
    return found


def lsh_candidates(codes: DataFrame, ident: str, queries: DataFrame, bits: int, first_table: bool = False) -> DataFrame:
    """(query, candidate): rows whose code differs from the query's in one bit at most: each query probes its bucket and those one bit away.

    With codes of several tables, rows that are found in any of them; on request with the first such table.
    """
    keys = ["table", "code"] if "table" in codes.columns else ["code"]
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(bits)))
    probes = queries.select(F.col(ident).alias("query"), *keys[:-1], F.explode(F.transform(flips, lambda f: F.col("code").bitwiseXOR(f))).alias("code"))
    met = probes.join(codes.select(F.col(ident).alias("candidate"), *keys), keys).where("query <> candidate")
    if first_table:
        return met.groupBy("query", "candidate").agg(F.min("table").alias("table"))
    return met.select("query", "candidate").distinct()


def ranked_candidates(candidates: DataFrame, vectors: DataFrame, ident: str, vector: str, queries: DataFrame, least: int) -> DataFrame:
    """(query, candidate, cosine, place): all candidates of each query by cosine, of equals the smaller id; a query with under `least` gets all rows."""
    unit = lambda df, i, v: df.select(F.col(ident).alias(i), F.transform(vector, lambda x: x.cast("double") / F.sqrt(dot(vector, vector))).alias(v))
    enough = candidates.groupBy("query").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    few = queries.select(F.col(ident).alias("query")).distinct().join(enough, "query", "left_anti")
    rest = few.crossJoin(vectors.select(F.col(ident).alias("candidate"))).where("query <> candidate")
    pairs = candidates.join(enough, "query", "left_semi").unionByName(rest)
    scored = pairs.join(unit(vectors, "candidate", "_v"), "candidate").join(unit(queries, "query", "_q"), "query").select("query", "candidate", F.round(dot("_v", "_q"), 9).alias("cosine"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "candidate")).cast("long"))


def session_votes(history: DataFrame, current: DataFrame, session: str, item: str, k: int, neighbours: int) -> DataFrame:
    """(session, item, votes, place): items of the `neighbours` past sessions that share most items (over the root of both sizes), summed.

    The past sessions of an item are spread over salts, one for every 50,000 of them, and the current ones are sent to
    each, so that an item of any share of the sessions is joined in many tasks.
    """
    past, now = (d.select(F.col(session).alias(s), item).distinct() for d, s in ((history, "_past"), (current, "_now")))
    sizes = lambda d, s, n: d.groupBy(s).agg(F.count(F.lit(1)).alias(n))
    parts = past.groupBy(item).agg(F.ceil(F.count(F.lit(1)) / 50_000).cast("int").alias("_parts"))
    salted = past.join(parts, item).withColumn("_salt", F.pmod(F.xxhash64("_past"), F.col("_parts")).cast("int")).drop("_parts")
    asked = now.join(parts, item).select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt")).drop("_parts")
    shared = asked.join(salted, [item, "_salt"]).groupBy("_now", "_past").agg(F.count(F.lit(1)).alias("c"))
    near = shared.join(sizes(past, "_past", "a"), "_past").join(sizes(now, "_now", "b"), "_now").where("_now <> _past")
    near = near.withColumn("s", F.round(F.col("c") / F.sqrt(F.col("a").cast("double") * F.col("b")), 9))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("_now").orderBy(F.desc("s"), "_past"))).where(F.col("_r") <= neighbours)
    votes = near.join(past, "_past").join(now, ["_now", item], "left_anti").groupBy("_now", item).agg(F.round(F.sum("s"), 9).alias("votes"))
    return votes.withColumn("place", F.row_number().over(Window.partitionBy("_now").orderBy(F.desc("votes"), item)).cast("long")).where(F.col("place") <= k).withColumnRenamed("_now", session)

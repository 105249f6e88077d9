"""Steps between consecutive items, neighbours, and vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.session import materialize


def transitions(events: DataFrame, partition: Sequence[str], order: Sequence[str], node: str, *, allow_same: bool = False) -> DataFrame:
    """(source, target, n, out_share, in_share) of consecutive nodes within a partition, different ones unless allow_same."""
    w = Window.partitionBy(*partition).orderBy(*order)
    steps = events.select(*partition, *order, node).withColumn("source", F.lag(node).over(w)).withColumnRenamed(node, "target").where("source is not null and target is not null")
    if not allow_same:
        steps = steps.where("source <> target")
    n = steps.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    share = lambda side: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(side)), 9)
    return n.withColumns({"out_share": share("source"), "in_share": share("target")})


def node_profile(edges: DataFrame, nodes: int) -> DataFrame:
    """Per source: out, different targets and the entropy of its steps, smoothed by one for each of `nodes` targets."""
    total = F.sum("n") + nodes
    entropy = F.log(total.cast("double")) - F.sum((F.col("n") + 1) * F.log((F.col("n") + 1).cast("double"))) / total  # targets not seen add 1 * ln 1 = 0
    return edges.groupBy("source").agg(F.sum("n").alias("out"), F.count(F.lit(1)).alias("targets"), F.round(entropy, 9).alias("entropy"))


def degree_profile(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Per node, also those without steps: out, in, different targets and the entropy of node_profile over as many targets as there are nodes."""
    every = nodes.select(F.col(node).alias("source")).distinct()
    n = every.count()
    into = edges.groupBy(F.col("target").alias("source")).agg(F.sum("n").alias("in"))
    found = every.join(node_profile(edges, n), "source", "left").join(into, "source", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("out", "in", "targets")}
    return found.withColumns(zero | {"entropy": F.coalesce("entropy", F.round(F.log(F.lit(float(n))), 9))}).select(F.col("source").alias(node), "out", "in", "targets", "entropy")


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_neighbours(vectors: DataFrame, ident: str, vector: str, queries: DataFrame, k: int, *, block: int = 4_096) -> DataFrame:
    """(query, neighbour, cosine, place): the k nearest of all rows for each of the given query rows, itself left out; of equals the smaller id.

    The stated query set against all rows, in blocks: about `block` queries at a time, by a hash of their id, are sent to the
    tasks as a matrix, which each batch of rows is multiplied with; a partition passes on its k best of each query. Ids are
    numbers; null ids and vectors, and vectors of length 0, take no part.
    """
    kept = lambda df: df.select(F.col(ident).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("i is not null and v is not null and size(v) > 0")
    rows, asked = kept(vectors), materialize(kept(queries), "asked")
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        sent = vectors.sparkSession.sparkContext.broadcast((part["i"].to_numpy(), _units(np.stack(part["v"].to_numpy()))))

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, asked_ = sent.value
            best = [np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)]
            for batch in batches:
                if not batch.num_rows:
                    continue
                mine = batch["i"].to_numpy()
                units = _units(np.stack(batch["v"].to_numpy(zero_copy_only=False)))
                cosine = np.round(asked_ @ units.T, 9)
                cosine[(ids[:, None] == mine[None, :]) | ~np.isfinite(cosine)] = -np.inf
                cosine, names = np.hstack([best[0], cosine]), np.hstack([best[1], np.broadcast_to(mine, (len(ids), len(mine)))])
                # a row comes first by its cosine, of equals by its id
                order = np.lexsort((names, -cosine), axis=1)[:, :k]
                best = [np.take_along_axis(cosine, order, 1), np.take_along_axis(names, order, 1)]
            score, name = best
            there = np.isfinite(score)
            query = np.broadcast_to(ids[:, None], score.shape)
            yield from pa.table({"query": query[there], "neighbour": name[there], "cosine": score[there]}).to_batches(max_chunksize=10_000)

        some = rows.mapInArrow(nearest, "query long, neighbour long, cosine double")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query long, neighbour long, cosine double, place long")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")).cast("long")).where(F.col("place") <= k)


def _units(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def beam(edges: DataFrame, start: str, depth: int, width: int) -> DataFrame:
    """(path, score): the `width` best paths of so many steps from a node, by product of out_share, without a node twice; each step keeps `width` paths."""
    paths = edges.sparkSession.createDataFrame([([start], 1.0)], "path array<string>, score double")
    for _ in range(depth):
        more = paths.withColumn("source", F.element_at("path", -1)).join(edges.select("source", "target", "out_share"), "source").where(~F.array_contains("path", F.col("target")))
        more = more.select(F.concat("path", F.array("target")).alias("path"), F.round(F.col("score") * F.col("out_share"), 12).alias("score"))
        paths = more.orderBy(F.desc("score"), "path").limit(width)
    return paths

"""The N best rows of every group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.session import materialize


def _prune(table: pa.Table, n: int) -> tuple[pa.Table, np.ndarray]:
    """The n best different ids of each group, best first; their ranks from 0."""
    table = table.take(pc.sort_indices(table, [("bin", "ascending"), ("score", "descending"), ("id", "ascending")])).combine_chunks()
    if table.num_rows == 0:
        return table, np.zeros(0, np.int64)
    group, ident = table["bin"].combine_chunks(), table["id"].combine_chunks()
    fresh, other = np.ones(table.num_rows, bool), np.ones(table.num_rows, bool)
    fresh[1:] = pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)
    other[1:] = fresh[1:] | pc.not_equal(ident[1:], ident[:-1]).to_numpy(zero_copy_only=False)
    table, fresh = table.filter(pa.array(other)), fresh[other]
    at = np.arange(table.num_rows)
    rank = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return table.filter(pa.array(rank < n)), rank[rank < n]


def partition_best(rows: DataFrame, n: int, every: int = 250_000) -> DataFrame:
    """The n best rows of each group in each partition, with their place there from 0. No shuffle.

    Memory holds the best n rows of the partition's groups and `every` more.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[pa.RecordBatch] = []
        kept, waiting = None, 0
        for batch in batches:
            pool.append(batch)
            waiting += batch.num_rows
            if waiting >= every:
                kept, _ = _prune(pa.concat_tables([*([kept] if kept is not None else []), pa.Table.from_batches(pool)]), n)
                pool, waiting = [], 0
        if pool or kept is not None:
            kept, rank = _prune(pa.concat_tables([*([kept] if kept is not None else []), *([pa.Table.from_batches(pool)] if pool else [])]), n)
            yield from kept.append_column("local", pa.array(rank.astype(np.int32))).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(best, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, local int")


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int, *, most_bounds: int = 100_000) -> DataFrame:
    """The n rows with the highest score of every group; of equal scores those with the smaller id. Columns: bin, score, id, place.

    One scan without a shuffle leaves the n best rows of each group and partition, of any group however large. A
    partition's n-th best row bounds its group from below; the best bound of each group is joined to these rows and
    filters them, and only what survives is shuffled by group and ranked. Bounds hold score and id, so that a group of
    equal scores is cut down as well. The join is a broadcast, for which the size is bounded: the bounds of the
    most_bounds groups that have most of them are sent, by a 64-bit hash of the group (groups that share a hash take
    the lower bound); rows of other groups are ranked without one.

    Rows with null group, null id or null or NaN score take no part; repeats of an id in a group (same score) count
    once; groups with fewer rows give what they have; an empty table gives no rows; other columns are not read.
    """
    value = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("bin"), value.alias("score"), F.col(ident).alias("id")).where("bin is not null and id is not null and score is not null and not isnan(score)")
    local = materialize(partition_best(rows, n).withColumn("hash", F.xxhash64("bin")), "best")
    worse = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    bounds = local.where(F.col("local") == n - 1).groupBy("hash", "bin").agg(F.min(worse).alias("bound"), F.count(F.lit(1)).alias("n"))
    sent = bounds.where("n > 1").groupBy("hash").agg(F.max("bound").alias("bound"), F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(most_bounds).drop("n")
    alive = local.join(F.broadcast(sent), "hash", "left").where(F.col("bound").isNull() | (worse <= F.col("bound"))).select("bin", "score", "id")
    place = F.dense_rank().over(Window.partitionBy("bin").orderBy(F.desc("score"), "id"))
    return alive.withColumn("place", place).where(F.col("place") <= n).dropDuplicates(["bin", "id"])

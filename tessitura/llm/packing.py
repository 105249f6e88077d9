"""Items put into containers of one capacity, best fit in order of decreasing size."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.session import materialize

#: Items of one size that are numbered in one task.
ITEMS_AT_ONCE = 250_000


class OpenBins:
    """Bins by remaining capacity: a segment tree whose leaves 0..capacity say whether a bin with so much room is open."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)
        self.runs: dict[int, deque[tuple[int, int]]] = {}

    def _mark(self, room: int, on: bool) -> None:
        at = self.width + room
        self.any[at] = on
        while at > 1:
            at //= 2
            on = self.any[2 * at] or self.any[2 * at + 1]
            if self.any[at] == on:
                break
            self.any[at] = on

    def add(self, room: int, first: int, bins: int, front: bool = False) -> None:
        """Bins first, first + 1, ... with this much room."""
        runs = self.runs.setdefault(room, deque())
        if not runs:
            self._mark(room, True)
        runs.appendleft((first, bins)) if front else runs.append((first, bins))

    def take(self, room: int) -> tuple[int, int]:
        """The run of bins of this room that was added first."""
        run = self.runs[room].popleft()
        if not self.runs[room]:
            self._mark(room, False)
        return run

    def tightest(self, size: int) -> int:
        """The least room of an open bin that is at least size, or -1: up the tree to the first part right of size, then down it."""
        at = self.width + size
        if at >= 2 * self.width:
            return -1
        if not self.any[at]:
            while at > 1 and not (at % 2 == 0 and self.any[at + 1]):
                at //= 2
            if at <= 1:
                return -1
            at += 1
            while at < self.width:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.width


@dataclass
class Plan:
    """Items in order of decreasing size, numbered from 0: those from start[i] on fill bin[i], bin[i] + 1, ..., each[i] to a bin."""

    start: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    bins: int = 0

    def step(self, at: int, each: int, first: int) -> None:
        self.start.append(at)
        self.each.append(each)
        self.bin.append(first)

    def table(self) -> np.ndarray:
        """start, each and bin as three rows of numbers."""
        return np.array([self.start, self.each, self.bin], np.int64).reshape(3, -1)


def place(steps: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The bins of items with these numbers, by the steps of a plan."""
    start, each, first = steps
    i = np.searchsorted(start, item, "right") - 1
    return first[i] + (item - start[i]) // each[i]


def best_fit_decreasing(sizes: Mapping[int, int], capacity: int) -> Plan:
    """The bins of best-fit decreasing, for `sizes`: how many items there are of each size from 1 to capacity.

    Item by item, the tightest open bin takes an item of this size and is then itself the tightest until it is full;
    so bins of like room are filled one after the other, and a run of them is one step. Work and memory follow the
    number of different sizes and runs, not the number of items.
    """
    plan, open_bins, at = Plan(), OpenBins(capacity), 0
    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        while left:
            room = open_bins.tightest(size)
            if room < 0:
                fresh = -(-left // (capacity // size))
                open_bins.add(capacity, plan.bins, fresh)
                plan.bins, room = plan.bins + fresh, capacity
            each = room // size
            first, bins = open_bins.take(room)
            if full := min(bins, left // each):
                plan.step(at, each, first)
                open_bins.add(room - each * size, first, full)
                at, left, first, bins = at + full * each, left - full * each, first + full, bins - full
            if bins and left:  # fewer than fill a bin
                plan.step(at, left, first)
                open_bins.add(room - left * size, first, 1)
                at, left, first, bins = at + left, 0, first + 1, bins - 1
            if bins:
                open_bins.add(room, first, bins, front=True)
    return plan


def pack(items: DataFrame, ident: str, size: str, capacity: int) -> DataFrame:
    """(id, part, size, bin): a container for every item, by best-fit decreasing over all items.

    An item larger than the capacity is cut into parts of the capacity and the rest; no other is. The driver gets how
    many items there are of each size (`capacity` numbers, however many items) and plans the bins: runs of like bins are
    filled in one step, of which there are at most a few for each pair of sizes, so that a plan is bounded by the square
    of the capacity and is sent to the tasks as three arrays of numbers. Items are then numbered within size and salt; a
    size has as many salts as it has ITEMS_AT_ONCE items, so that one that a third of all items have is ordered in as
    many tasks as it needs. Their counts by salt, from which the numbers start, stay a table. The result is the same on
    every run.

    Items of size 0, null or negative size take no room: their size is 0 and their bin the first, 0. Repeated ids are
    items of their own; a null id is an item as well. An empty table gives no rows; other columns are not read.
    """
    spark = items.sparkSession
    room = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    whole = items.select(F.col(ident).alias("id"), room.alias("whole"))
    last = F.greatest(F.ceil(F.col("whole") / F.lit(capacity)).cast("int") - 1, F.lit(0))
    parts = whole.select("id", "whole", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    sized = parts.select("id", "part", F.least(F.col("whole") - F.col("part").cast("long") * capacity, F.lit(capacity)).cast("int").alias("size"))
    sized = materialize(sized, "sizes")

    counts = {r["size"]: r["count"] for r in sized.where("size > 0").groupBy("size").count().collect()}
    plan = spark.sparkContext.broadcast(best_fit_decreasing(counts, capacity).table())
    salts = F.lit(1)
    for n, group in groupby(sorted(counts, key=lambda s: -(-counts[s] // ITEMS_AT_ONCE)), key=lambda s: -(-counts[s] // ITEMS_AT_ONCE)):
        salts = F.when(F.col("size").isin(*group), n).otherwise(salts) if n > 1 else salts

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = batch["offset"].to_numpy() + batch["place"].to_numpy() - 1
            yield pa.RecordBatch.from_arrays([batch["id"], batch["part"], batch["size"], pa.array(place(plan.value, item))], ["id", "part", "size", "bin"])

    salted = sized.where("size > 0").withColumn("salt", F.pmod(F.xxhash64("id", "part"), salts.cast("long")).cast("int"))
    above = [[s, n] for s, n in zip(sorted(counts, reverse=True), np.cumsum([0] + [counts[s] for s in sorted(counts, reverse=True)]).tolist())]
    of_size = spark.createDataFrame(above or [[0, 0]], "size int, above long")
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    offsets = offsets.join(F.broadcast(of_size), "size").select("size", "salt", (F.col("offset") + F.col("above")).alias("offset"))
    order = Window.partitionBy("size", "salt").orderBy("id", "part")
    numbered = salted.withColumn("place", F.row_number().over(order).cast("long")).join(offsets, ["size", "salt"])
    placed = numbered.mapInArrow(lay, f"id {dict(items.dtypes)[ident]}, part int, size int, bin long")
    return placed.unionByName(sized.where("size = 0").select("id", "part", "size", F.lit(0).cast("long").alias("bin")))

"""Counts of pairs by stripes: per item an array of the items beside it, merged by item."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.session import materialize, release

STRIPE_SCHEMA = "item long, block int, neighbours array<long>, counts array<long>"
PAIR_SCHEMA = "low long, high long, n_ab long"
#: Pairs made at once, entries of one stripe row, entries held of one item before they are merged.
PAIRS_AT_ONCE, ROW_ENTRIES, HELD_ENTRIES = 4_000_000, 8_192, 4_000_000


def _pair_codes(local: np.ndarray, sizes: np.ndarray, width: int, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Codes low * width + high of all pairs of the baskets, whose items are ascending numbers below width.

    Of a basket in slices, the pairs whose lower item stands at first, first + step, ...
    """
    starts, out = np.cumsum(sizes) - sizes, []
    whole = step == 1
    for k in np.unique(sizes[whole]):
        if k < 2:
            continue
        low, high = np.triu_indices(int(k), 1)
        at = starts[whole & (sizes == k)]
        for some in np.array_split(at, max(1, len(at) * len(low) // PAIRS_AT_ONCE)):
            ids = local[some[:, None] + np.arange(k)]
            out.append((ids[:, low] * width + ids[:, high]).ravel())
    for b in np.flatnonzero(~whole):
        ids = local[starts[b] : starts[b] + sizes[b]]
        out += [ids[j] * width + ids[j + 1 :] for j in range(int(first[b]), len(ids) - 1, int(step[b]))]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _stripes(flat: np.ndarray, sizes: np.ndarray, first: np.ndarray, step: np.ndarray, heavy: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The associative arrays of these baskets: per item its neighbours of larger number, with counts.

    The array of the i-th of the heavy items is cut into 2 ** bits[i] blocks by its neighbours.
    """
    names, local = np.unique(flat, return_inverse=True)
    width = max(len(names), 1)
    basket = np.repeat(np.arange(len(sizes)), sizes)
    local = np.sort(basket * width + local) % width
    code, count = np.unique(_pair_codes(local, sizes, width, first, step), return_counts=True)
    if not len(code):
        return
    low, high = code // width, names[code % width]
    spread = np.zeros(len(names), np.int64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, names), len(heavy) - 1)
        spread = np.where(heavy[at] == names, bits[at], 0)
    spread = spread[low]
    block = np.where(spread > 0, (high >> 1 & 0x7FFFFFFFFFFFFFFF) >> (63 - np.maximum(spread, 1)), 0)
    edge = np.ones(len(code), bool)
    edge[1:] = (low[1:] != low[:-1]) | (block[1:] != block[:-1])
    at = np.arange(len(code))
    edge |= (at - np.maximum.accumulate(np.where(edge, at, 0))) % ROW_ENTRIES == 0
    begin = np.flatnonzero(edge)
    offsets = pa.array(np.append(begin, len(code)).astype(np.int32))
    yield from pa.table(
        {"item": names[low[begin]], "block": block[begin].astype(np.int32), "neighbours": pa.ListArray.from_arrays(offsets, pa.array(high)), "counts": pa.ListArray.from_arrays(offsets, pa.array(count))}
    ).to_batches(max_chunksize=5_000)


def _merge(item: np.ndarray, block: np.ndarray, sizes: np.ndarray, neighbours: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrays of the same item and block added up: item, block, neighbour, count, in order."""
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (block[1:] != block[:-1])
    group = np.repeat(np.cumsum(new) - 1, sizes)
    order = np.lexsort((neighbours, group))
    group, neighbours, counts = group[order], neighbours[order], counts[order]
    edge = np.ones(len(group), bool)
    edge[1:] = (group[1:] != group[:-1]) | (neighbours[1:] != neighbours[:-1])
    begin = np.flatnonzero(edge)
    of = np.flatnonzero(new)[group[begin]]
    return item[of], block[of], neighbours[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    lists = batch["neighbours"]
    return batch["item"].to_numpy(), batch["block"].to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(), batch["counts"].flatten().to_numpy()


def _summed(least: int):
    """Adds up the arrays of each item and block, which lie together, and gives the pairs that are often enough."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = merged = 0  # entries held, and of these entries that are added up already

        def together() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held))

        def pairs(parts: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            low, _, high, n = _merge(*parts)
            often = n >= least
            yield from pa.table({"low": low[often], "high": high[often], "n_ab": n[often]}).to_batches(max_chunksize=10_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = _columns(batch)
            item, block, sizes, neighbours, counts = now
            same = (item == item[-1]) & (block == block[-1])
            if held and (held[0][0][-1], held[0][1][-1]) == (item[-1], block[-1]) and same.all():
                held.append(now)
                size += len(neighbours)
                # what is added up is sorted again only when as much has come again: the work is in proportion to the rows
                if size > HELD_ENTRIES and size > 2 * merged:
                    a, b, c, d = _merge(*together())
                    held, size, merged = [(a[:1], b[:1], np.array([len(c)]), c, d)], len(c), len(c)
                continue
            held.append(now)
            item, block, sizes, neighbours, counts = together()
            differs = np.flatnonzero((item != item[-1]) | (block != block[-1]))
            tail = int(differs[-1]) + 1 if len(differs) else 0
            cutting = int(sizes[:tail].sum())
            if tail:
                yield from pairs((item[:tail], block[:tail], sizes[:tail], neighbours[:cutting], counts[:cutting]))
                merged = 0
            held = [(item[tail:], block[tail:], sizes[tail:], neighbours[cutting:], counts[cutting:])]
            size = len(neighbours) - cutting
        if held:
            yield from pairs(together())

    return merge


def numbered(items: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """items, written once, with a 64-bit number each that is unique: another seed is taken where two would share one."""
    seed = 0
    while True:
        found = materialize(items.withColumn("number", F.xxhash64(*keys, F.lit(seed))), "items")
        if found.groupBy("number").count().where("count > 1").limit(1).count() == 0:
            return found, seed
        release(found)
        seed += 1


def pair_counts(baskets: DataFrame, numbers: str, least: int = 1, often: DataFrame | None = None) -> DataFrame:
    """(low, high, n_ab): how many baskets hold both of two items, for pairs in at least `least` of them.

    baskets: an array<long> of different item numbers in each row. often: (number, bits) of the most frequent items, a list
    that must be short: those with negative bits are left out, the arrays of the others are merged in 2 ** bits blocks. Each
    task merges the stripes (item -> neighbours with counts) of its baskets before they are shuffled by item, and the arrays
    that meet there are added up. Baskets of over PAIRS_AT_ONCE pairs are worked on in slices in different tasks.
    """
    names = bits = np.zeros(0, np.int64)
    if often is not None:
        listed = often.orderBy("number").toArrow()
        names, bits = listed["number"].to_numpy().astype(np.int64), listed["bits"].to_numpy().astype(np.int64)
    sent = baskets.sparkSession.sparkContext.broadcast((names[bits < 0], names[bits > 0], bits[bits > 0]))
    size = F.size(numbers).cast("long")
    sliced = baskets.select(F.col(numbers).alias("numbers"), F.ceil(size * (size - 1) / 2 / F.lit(PAIRS_AT_ONCE)).cast("int").alias("step"))
    small = sliced.where("step <= 1").select("numbers", F.lit(0).alias("first"), F.lit(1).alias("step"))
    large = sliced.where("step > 1").select("numbers", F.explode(F.sequence(F.lit(0), F.col("step") - 1)).alias("first"), "step")
    large = large.repartition(F.col("numbers")[0], "first")

    def stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        never, *heavy = sent.value
        waiting: list[tuple[np.ndarray, ...]] = []
        pairs = 0
        for batch in batches:
            lists, first, step = batch["numbers"], batch["first"].to_numpy().astype(np.int64), batch["step"].to_numpy().astype(np.int64)
            sizes, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
            good = ~np.isin(flat, never)
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=good, minlength=len(sizes)).astype(np.int64)
            flat = flat[good]
            ends = np.cumsum(sizes)
            made = np.cumsum(sizes * (sizes - 1) // 2 // step)
            done = 0
            while done < len(sizes):
                room = PAIRS_AT_ONCE - pairs + (made[done - 1] if done else 0)
                upto = max(int(np.searchsorted(made, room, "right")), done + (not waiting))
                if upto > done:
                    waiting.append((flat[ends[done] - sizes[done] : ends[upto - 1]], sizes[done:upto], first[done:upto], step[done:upto]))
                    pairs += int(made[upto - 1] - (made[done - 1] if done else 0))
                    done = upto
                if done < len(sizes):
                    yield from _stripes(*(np.concatenate(x) for x in zip(*waiting)), *heavy)
                    waiting, pairs = [], 0
        if waiting:
            yield from _stripes(*(np.concatenate(x) for x in zip(*waiting)), *heavy)

    stripe = small.unionByName(large).mapInArrow(stripes, STRIPE_SCHEMA).repartition("item", "block").sortWithinPartitions("item", "block")
    return stripe.mapInArrow(_summed(least), PAIR_SCHEMA)

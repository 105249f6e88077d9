"""Cartesian trees over gaps between consecutive times, merged over chunks of time, and sessions cut from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.session import materialize

DAY_US = 86_400_000_000
#: Columns of a tree: a row for every entity and chunk (a chunk of very many events has several pieces).
TREE_SCHEMA = "entity string, chunk long, piece int, loose_left boolean, loose_right boolean, widest long, top int, times array<long>, below_left array<int>, below_right array<int>, keys array<string>"
CROWN_SCHEMA = "entity string, chunks array<long>, pieces array<int>, gaps array<long>, below_left array<int>, below_right array<int>, top int"
SEGMENT_SCHEMA = "gap_us long, entity string, chunk long, piece int, side int, start_us long, end_us long, event_count long, key_count long, keys array<string>"
RUN_SCHEMA = "gap_us long, entity string, chunk long, piece int, run_left long, run_right long"


def cartesian_tree(gaps: Sequence[int]) -> tuple[list[int], list[int], int]:
    """Left child, right child (-1: none) and root of the tree with the largest gap on top; of equal gaps the earlier.

    One pass with a stack that holds the right spine.
    """
    left, right, spine = [-1] * len(gaps), [-1] * len(gaps), []
    for i, gap in enumerate(gaps):
        under = -1
        while spine and gaps[spine[-1]] < gap:
            under = spine.pop()
        left[i] = under
        if spine:
            right[spine[-1]] = i
        spine.append(i)
    return left, right, spine[0] if spine else -1


def cartesian_forest(gaps: Sequence[int], starts: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """As cartesian_tree() for each stretch of gaps that begins at one of starts; the gap at a start is no node.

    Left and right children are positions in the whole; the roots come stretch by stretch.
    """
    left, right, tops, spine = [-1] * len(gaps), [-1] * len(gaps), [], []
    for begin, end in zip(starts, [*starts[1:], len(gaps)]):
        spine.clear()
        for i in range(begin + 1, end):
            gap, under = gaps[i], -1
            while spine and gaps[spine[-1]] < gap:
                under = spine.pop()
            left[i] = under
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        tops.append(spine[0] if spine else -1)
    return left, right, tops


def cut(gaps: Sequence[int], left: Sequence[int], right: Sequence[int], top: int, longest: int) -> list[int]:
    """Positions of the gaps over `longest`, in order. Visits these nodes and their children only."""
    found, todo = [], [top]
    while todo:
        i = todo.pop()
        if i >= 0 and gaps[i] > longest:
            found.append(i)
            todo.append(left[i])
            todo.append(right[i])
    found.sort()
    return found


def _chunked(events: DataFrame, entity: str, time: str, event_id: str, key: str | None, chunk_us: int) -> DataFrame:
    """The columns needed, laid out by entity and chunk and in order of time."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    label: Column = F.lit(None).cast("string") if key is None else F.when(F.col(key).cast("string") != "", F.col(key).cast("string"))
    return (
        events.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
        .select(F.col(entity).cast("string").alias("entity"), us.alias("us"), F.col(event_id).alias("event_id"), label.alias("key"))
        .withColumn("chunk", F.expr(f"(us - pmod(us, {chunk_us}L)) div {chunk_us}L"))
        .repartition("entity", "chunk")
        .sortWithinPartitions("entity", "chunk", "us", "event_id")
    )


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray, int, bool]]:
    """Whole chunks: (rows, start of each chunk, number of the first one's piece, whether the last one goes on).

    A chunk of more than `most` events is passed on in pieces, so that memory stays bounded.
    """
    rest: pa.Table | None = None
    last_seen: tuple | None = None
    piece = 0

    def starts_of(table: pa.Table) -> np.ndarray:
        entity, chunk = table["entity"].combine_chunks(), table["chunk"].to_numpy()
        new = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            new[1:] = pc.not_equal(entity[1:], entity[:-1]).to_numpy(zero_copy_only=False) | (chunk[1:] != chunk[:-1])
        return np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        # repeats of an event lie beside it
        entity, us, ids = table["entity"].combine_chunks(), table["us"].to_numpy(), table["event_id"].combine_chunks()
        again = np.zeros(table.num_rows, bool)
        if table.num_rows > 1:
            same = pc.and_(pc.equal(entity[1:], entity[:-1]), pc.equal(ids[1:], ids[:-1]))
            again[1:] = pc.fill_null(same, False).to_numpy(zero_copy_only=False) & (us[1:] == us[:-1])
        head, last = (entity[0].as_py(), int(us[0]), ids[0].as_py()), table.num_rows - 1
        again[0] = head == last_seen and head[2] is not None
        last_seen = (entity[last].as_py(), int(us[last]), ids[last].as_py())
        table = table.filter(pa.array(~again)) if again.any() else table
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows == 0:
            rest = None
            continue
        starts = starts_of(rest)
        tail = int(starts[-1])
        if tail:
            yield rest.slice(0, tail), starts[:-1], piece, False
            rest, piece = rest.slice(tail), 0
        if rest.num_rows > most:  # its last event is kept back, so that another piece surely follows
            yield rest.slice(0, rest.num_rows - 1), np.array([0]), piece, True
            rest, piece = rest.slice(rest.num_rows - 1), piece + 1
    if rest is not None and rest.num_rows:
        yield rest, starts_of(rest), piece, False


def _lists(offsets: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _trees(rows: pa.Table, starts: np.ndarray, first_piece: int, goes_on: bool) -> pa.RecordBatch:
    """The trees of these chunks."""
    us, n = rows["us"].to_numpy(), rows.num_rows
    gaps = np.zeros(n, np.int64)
    gaps[1:] = us[1:] - us[:-1]
    left, right, tops = cartesian_forest(gaps.tolist(), starts.tolist())
    ends = np.append(starts, n)
    of = np.repeat(starts, np.diff(ends))
    local = lambda child: np.where(np.array(child) < 0, -1, np.array(child) - of).astype(np.int32)
    tops = np.array(tops)
    piece, open_right = np.zeros(len(starts), np.int32), np.zeros(len(starts), bool)
    piece[0], open_right[-1] = first_piece, goes_on
    columns = {
        "entity": rows["entity"].combine_chunks().take(pa.array(starts)),
        "chunk": rows["chunk"].to_numpy()[starts],
        "piece": piece,
        "loose_left": piece > 0,
        "loose_right": open_right,
        "widest": np.where(tops < 0, -1, gaps[tops]),
        "top": np.where(tops < 0, -1, tops - starts).astype(np.int32),
        "times": _lists(ends, us),
        "below_left": _lists(ends, local(left)),
        "below_right": _lists(ends, local(right)),
        "keys": _lists(ends, rows["key"].combine_chunks().cast(pa.string())),
    }
    return pa.RecordBatch.from_pydict(columns)


@dataclass(frozen=True)
class Forest:
    """The merged Cartesian tree of every entity, in two tables that may be written and read again.

    trees: the part of each chunk of time. crowns: what joins the parts of an entity: the tree over the widest gap of
    each part and the gaps between neighbouring parts. A cut goes from the crown's root to the parts whose widest gap is
    over the setting, and on in these. An entity's crown has two nodes a part, however many events there are.
    """

    trees: DataFrame
    crowns: DataFrame
    chunk_us: int


def gap_forest(events: DataFrame, entity: str, time: str, event_id: str, key: str | None = None, *, chunk_us: int = DAY_US, most: int = 50_000) -> Forest:
    """The merged Cartesian tree over the gaps of every entity, written to the shared folder, to be cut at any gap by forest_sessions().

    Chunks of time spread an entity with any share of the rows over the tasks; a chunk of over `most` events is kept in
    pieces. The parts of an entity then meet in its crown, which one task builds from one small row a part. Rows without
    entity or time are left out; rows that repeat an event_id (which carry the same entity and time) count once; a null
    event_id is an event of its own; an empty table gives an empty forest; other columns are not read.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, most):
            yield _trees(*part)

    trees = materialize(_chunked(events, entity, time, event_id, key, chunk_us).mapInArrow(grow, TREE_SCHEMA), "trees")
    part = F.struct("chunk", "piece", F.element_at("times", 1).alias("first"), F.element_at("times", -1).alias("last"), "widest")
    parts = trees.select("entity", part.alias("part")).groupBy("entity").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return Forest(trees, materialize(parts.mapInArrow(_crowns, CROWN_SCHEMA), "crowns"), chunk_us)


def _crowns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per entity the tree over widest gap of part, gap to the next part, widest gap of that part, and so on."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch["parts"].value_lengths().to_numpy().astype(np.int64)
        flat = batch["parts"].flatten()
        first, last, widest = (flat.field(n).to_numpy() for n in ("first", "last", "widest"))
        ends = np.append(0, np.cumsum(sizes))
        starts = ends[:-1]
        between = np.zeros(len(first), np.int64)
        between[1:] = first[1:] - last[:-1]
        # a place before each entity's first part holds no gap: it starts the entity's stretch
        gaps = np.column_stack([between, widest]).ravel()
        left, right, tops = cartesian_forest(gaps.tolist(), (2 * starts).tolist())
        of = np.repeat(2 * starts, 2 * sizes)
        local = lambda child: np.where(np.array(child) < 0, -1, np.array(child) - of).astype(np.int32)
        columns = {
            "entity": batch["entity"],
            "chunks": _lists(ends, flat.field("chunk").to_numpy()),
            "pieces": _lists(ends, flat.field("piece").to_numpy()),
            "gaps": _lists(2 * ends, gaps),
            "below_left": _lists(2 * ends, local(left)),
            "below_right": _lists(2 * ends, local(right)),
            "top": (np.array(tops) - 2 * starts).astype(np.int32),
        }
        yield pa.RecordBatch.from_pydict(columns)


def _runs(gaps_us: Sequence[int]):
    """Cuts crowns: for each part the numbers of the sessions that its first and its last event lie in."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                gaps, left, right = (batch[c][i].values.to_pylist() for c in ("gaps", "below_left", "below_right"))
                n = len(gaps) // 2
                for longest in gaps_us:
                    ended = np.zeros(2 * n, np.int64)
                    ended[cut(gaps, left, right, batch["top"][i].as_py(), longest)] = 1
                    before = np.cumsum(ended)
                    columns = [np.full(n, longest), pa.array([batch["entity"][i].as_py()] * n, pa.string()), batch["chunks"][i].values, batch["pieces"][i].values, before[0::2], before[1::2]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["gap_us", "entity", "chunk", "piece", "run_left", "run_right"])

    return runs


def _segments(batch: pa.RecordBatch, gaps_us: Sequence[int], chunk_us: int, all_keys: bool) -> Iterator[pa.RecordBatch]:
    """Stretches of each tree between the cuts, for each setting. side: 0 for a whole session; else the crown says which
    session it is part of: 1 at the tree's left edge, 2 at its right one, 3 at both."""
    times, sizes = batch["times"].flatten(), batch["times"].value_lengths().to_numpy().astype(np.int64)
    us = times.to_numpy()
    starts = np.append(0, np.cumsum(sizes))
    tops, chunk = batch["top"].to_numpy(), batch["chunk"].to_numpy()
    gaps = np.zeros(len(us), np.int64)
    gaps[1:] = us[1:] - us[:-1]
    of = np.repeat(starts[:-1], sizes)
    whole = lambda c: (lambda child: np.where(child < 0, -1, child + of).tolist())(batch[c].flatten().to_numpy())
    left, right, listed = whole("below_left"), whole("below_right"), gaps.tolist()
    roots = (tops + starts[:-1])[tops >= 0].tolist()
    coded = batch["keys"].flatten().dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(coded.dictionary) + 1
    for longest in gaps_us:
        cuts = [c for root in roots if listed[root] > longest for c in cut(listed, left, right, root, longest)]
        begin = np.sort(np.concatenate([starts[:-1], np.array(cuts, np.int64)]))
        after = np.append(begin[1:], len(us))
        tree = np.searchsorted(starts, begin, "right") - 1
        seg = np.repeat(np.arange(len(begin)), after - begin)
        pair = np.unique((seg * width + code)[code >= 0])
        which_seg, which = pair // width, pair % width
        start, end, at = us[begin], us[after - 1], chunk[tree]
        near_left = (start - at * chunk_us + 1 <= longest) | batch["loose_left"].to_numpy(zero_copy_only=False)[tree]
        near_right = ((at + 1) * chunk_us - end <= longest) | batch["loose_right"].to_numpy(zero_copy_only=False)[tree]
        side = np.where(near_left & (begin == starts[tree]), 1, 0) + np.where(near_right & (after == starts[tree + 1]), 2, 0)
        kept = np.ones(len(which_seg), bool) if all_keys else side[which_seg] > 0
        offsets = np.append(0, np.cumsum(np.bincount(which_seg[kept], minlength=len(begin))))
        yield pa.RecordBatch.from_pydict(
            {
                "gap_us": np.full(len(begin), longest, np.int64),
                "entity": batch["entity"].take(pa.array(tree)),
                "chunk": at,
                "piece": batch["piece"].to_numpy()[tree],
                "side": side.astype(np.int32),
                "start_us": start,
                "end_us": end,
                "event_count": after - begin,
                "key_count": np.bincount(which_seg, minlength=len(begin)).astype(np.int64),
                "keys": _lists(offsets, coded.dictionary.take(pa.array(which[kept]))),
            }
        )


def forest_sessions(forest: Forest, gaps_us: Sequence[int], *, with_keys: bool = False) -> DataFrame:
    """Sessions of each entity for each gap setting: a next event more than `gap` later starts another session.

    Columns gap_us, entity, start_us, end_us, event_count, and key_count (different non-blank keys) or, with_keys, keys.
    Each setting visits the cut nodes only, in the crowns and in the trees. Stretches of a tree that lie further from the
    edges of their chunk than the gap are whole sessions; the others (at most two a tree) are added up by the session
    that the crown's cut puts them in. Repeated settings count once.
    """
    settings, chunk_us = sorted(set(gaps_us)), forest.chunk_us

    def fell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _segments(batch, settings, chunk_us, with_keys)

    segments = materialize(forest.trees.mapInArrow(fell, SEGMENT_SCHEMA), "segments")
    runs = forest.crowns.mapInArrow(_runs(settings), RUN_SCHEMA)
    run = F.when(F.col("side") == 2, F.col("run_right")).otherwise(F.col("run_left"))
    edges = segments.where("side > 0").join(runs, ["gap_us", "entity", "chunk", "piece"]).withColumn("run", run)
    parts = edges.select("gap_us", "entity", "run", "start_us", "end_us", "event_count", F.posexplode_outer("keys").alias("at", "one_key"))
    once = F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("event_count")).otherwise(0)
    measures = [F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum(once).alias("event_count")]
    name = "keys" if with_keys else "key_count"
    keys = F.collect_set("one_key") if with_keys else F.countDistinct("one_key")
    joined = parts.groupBy("gap_us", "entity", "run").agg(*measures, keys.alias(name)).drop("run")
    return segments.where("side = 0").select("gap_us", "entity", "start_us", "end_us", "event_count", name).unionByName(joined)


def gap_sessions(
    events: DataFrame,
    entity: str,
    time: str,
    event_id: str,
    key: str | None = None,
    *,
    gaps_us: Sequence[int] = (1_800_000_000,),
    with_keys: bool = False,
    chunk_us: int = DAY_US,
    most: int = 50_000,
) -> DataFrame:
    """forest_sessions() of the events' gap_forest().

    Rows without entity or time are left out; repeats of an event_id (same entity and time) count once; equal times
    belong together; null or blank keys are not counted; an empty table gives no rows; other columns are not read.
    """
    return forest_sessions(gap_forest(events, entity, time, event_id, key, chunk_us=chunk_us, most=most), gaps_us, with_keys=with_keys)

"""Joins by time: the latest event at or before a row, and sums over the events of a window before it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def augment(
    rows: DataFrame,
    sources: Mapping[str, DataFrame],
    keys: Sequence[str],
    row_id: str,
    time_us: str,
    *,
    latest: Mapping[str, tuple[str, str]],
    sums: Mapping[str, tuple[str, str, int]],
    default: float | None = 0.0,
) -> DataFrame:
    """rows with as-of and window-sum columns from several sources, in one union and one shuffle by `keys`.

    latest: column -> (source, value): the value of the last event at or before the row's time, null if that event has
    none; of equal times the last in order of its `seq`; `default` where there is no such event. sums: column ->
    (source, value, microseconds): the sum over the events from that long before the row's time to it, both ends
    included; 0 where there is none. Sources have the keys, `time_us`, `seq` and their values. All columns of rows stay;
    a row whose time or keys are null meets nothing.
    """
    wanted = {c: (source, value) for c, (source, value) in latest.items()} | {c: (source, value) for c, (source, value, _) in sums.items()}
    own = F.struct(*rows.columns)
    nothing = F.lit(None).cast("struct<v:double>")
    kind = rows.select(own.alias("_own")).schema["_own"].dataType
    parts = [rows.select(*keys, F.col(time_us).alias("_t"), F.lit(1).alias("_row"), F.lit(None).cast("long").alias("_seq"), own.alias("_own"), *(nothing.alias(c) for c in wanted))]
    for name, source in sources.items():
        values = (F.struct(F.col(v).cast("double").alias("v")).alias(c) if src == name else nothing.alias(c) for c, (src, v) in wanted.items())
        parts.append(source.select(*keys, F.col("time_us").alias("_t"), F.lit(0).alias("_row"), F.col("seq").alias("_seq"), F.lit(None).cast(kind).alias("_own"), *values))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    order = Window.partitionBy(*keys).orderBy("_t", "_row", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    met = F.col("_t").isNotNull()
    for k in keys:
        met = met & F.col(k).isNotNull()
    found: dict[str, Column] = {}
    for c in latest:
        last = F.last(c, ignorenulls=True).over(order)
        found[c] = F.when(met & last.isNotNull(), last["v"]).otherwise(F.lit(default).cast("double"))
    for c, (_, _, us) in sums.items():
        within = F.sum(F.col(c)["v"]).over(Window.partitionBy(*keys).orderBy("_t").rangeBetween(-us, 0))
        found[c] = F.when(met, F.coalesce(within, F.lit(0.0))).otherwise(F.lit(0.0))
    return union.withColumns(found).where("_row = 1").select("_own.*", *wanted)


# The length of a block where no sum names one, and the last time there is.
DAY_US, END = 86_400_000_000, 2**63 - 1


def augment_in_blocks(
    rows: DataFrame,
    sources: Mapping[str, DataFrame],
    keys: Sequence[str],
    row_id: str,
    time_us: str,
    *,
    latest: Mapping[str, tuple[str, str]],
    sums: Mapping[str, tuple[str, str, int]],
    default: float | None = 0.0,
) -> DataFrame:
    """As augment(), for few keys with many events: tasks get blocks of time, not keys, and a sum costs the same however many events its window holds.

    Blocks are as long as the longest window and cut into pieces of each other window's length. A window ends in one
    piece and begins before it, so a sum is that of the piece's events up to the row, added up forwards, and that of
    earlier events which the window still holds, added up backwards by when it loses them; nothing is subtracted, so no
    infinite or large value is left behind. A block begins with the last events before it. Rows, and sources of `latest`,
    are read twice. An event whose time or keys are null is met by nothing.
    """
    length = {us: max(us, 1) for _, _, us in sums.values()}
    block = max(length.values(), default=DAY_US)
    pieces = {us: -(-block // n) for us, n in length.items()}
    kept = {name: found for name in sources if (found := [(c, v) for c, (src, v) in latest.items() if src == name])}
    last = {name: f"_last{i}" for i, name in enumerate(kept)}
    own = F.struct(*rows.columns)
    kind = rows.select(own.alias("_own")).schema["_own"].dataType
    blank = {"_t": "long", "_block": "long", "_row": "int", "_seq": "long", "_lost": "long"} | dict.fromkeys(sums, "double")
    blank |= {last[name]: "struct<" + ", ".join(f"`{c}`: double" for c, _ in found) + ">" for name, found in kept.items()}
    piece = lambda t, us: _cut(t, block) * pieces[us] + _cut(F.pmod(t, F.lit(block)), length[us])
    begin = lambda at, us: _cut(at, pieces[us]) * block + F.pmod(at, F.lit(pieces[us])) * length[us]
    values = lambda name: F.struct(*(F.col(v).cast("double").alias(c) for c, v in kept[name]))

    def part(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*keys, *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in blank.items()), given.get("_own", F.lit(None).cast(kind)).alias("_own"))

    t = F.col(time_us).cast("long")
    rows = rows.withColumn("_block", F.coalesce(_cut(t, block), F.pmod(F.xxhash64(row_id), F.lit(4096))))
    parts = [part(rows, _t=t, _block=F.col("_block"), _row=F.lit(1), _own=own)]
    ends = [rows.select("_block", *keys, F.lit(True).alias("_rows")).distinct()]
    for name, source in sources.items():
        s, mine = F.col("time_us"), {c: (v, us) for c, (src, v, us) in sums.items() if src == name}
        events = source.where(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, s.isNotNull()))
        # An event as such, and as what the window holds in the next piece, and in the one after it if that piece is a shorter one.
        copies = [(0, 0), *((us, n) for us in sorted({us for _, us in mine.values()} - {0}) for n in (1, 2)[: 1 + (block % length[us] > 0)])]
        copied = events.withColumn("_copy", F.explode(F.array(*(F.lit(i) for i in range(len(copies))))))
        at, wanted, lost = s, F.lit(True), F.lit(0)
        for i, (us, n) in enumerate(copies[1:], 1):
            this, next_, end = F.col("_copy") == i, piece(s, us) + 1, F.coalesce(F.try_add(s, F.lit(us)), F.lit(END))
            counts = reduce(or_, (F.coalesce(F.col(v).cast("double") != 0, F.lit(False)) for v, k in mine.values() if k == us))
            at = F.when(this, F.least(end, begin(next_ + 1, us) - 1) if n == 1 and block % length[us] else end).otherwise(at)
            wanted = F.when(this, counts & (piece(end, us) > next_) if n == 2 else counts).otherwise(wanted)
            lost = F.when(this, us).otherwise(lost)
        copied = copied.where(wanted).withColumns({"_at": at, "_lost": lost})
        given = {c: F.when(F.col("_lost").isin(0, us), F.col(v)) for c, (v, us) in mine.items()}
        if name in kept:
            given[last[name]] = F.when(F.col("_lost") == 0, values(name))
            found = events.select(_cut(s, block).alias("_block"), *keys, F.struct(s.alias("t"), F.col("seq").cast("long").alias("seq"), values(name).alias("v")).alias("_e"))
            ends.append(found.groupBy("_block", *keys).agg(F.max("_e")["v"].alias(last[name])))
        parts.append(part(copied, _t=F.col("_at"), _block=_cut(F.col("_at"), block), _row=F.lit(0), _seq=F.col("seq"), _lost=F.col("_lost"), **given))
    if kept:
        blocks = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ends)
        blocks = blocks.groupBy("_block", *keys).agg(F.max("_rows").alias("_rows"), *(F.first(c, ignorenulls=True).alias(c) for c in last.values()))
        earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        before = blocks.withColumns({c: F.last(c, ignorenulls=True).over(earlier) for c in last.values()}).where("_rows")
        parts.append(part(before, _block=F.col("_block"), _row=F.lit(-1), **{c: F.col(c) for c in last.values()}))
    union = reduce(DataFrame.unionByName, parts)
    fine = {us for us, n in pieces.items() if n > 1}
    union = union.withColumns({f"_{way}{us}": sign * piece(F.col("_t"), us) for us in fine for way, sign in (("up", 1), ("down", -1))})

    def so_far(us: int | None, way: str, *order: Column | str) -> Window:
        """Whole blocks are ordered by their smallest pieces first, which is the same order and saves a sort."""
        own_piece, first = [f"_{way}{us}"] if us in fine else [], [] if us in fine or not fine else [f"_{way}{min(fine)}"]
        return Window.partitionBy("_block", *keys, *own_piece).orderBy(*first, *order).rowsBetween(Window.unboundedPreceding, 0)

    met = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col("_t").isNotNull())
    found: dict[str, Column] = {}
    for name, c in last.items():
        event = F.last(c, ignorenulls=True).over(so_far(None, "up", "_t", "_row", "_seq"))
        found |= {n: F.when(met & event.isNotNull(), event[n]).otherwise(F.lit(default).cast("double")) for n, _ in kept[name]}
    for c, (_, _, us) in sums.items():
        of = lambda lost, c=c: F.sum(F.when(F.col("_lost") == lost, F.col(c)))
        within = F.coalesce(of(0).over(so_far(us, "up", "_t", "_row", "_seq")), F.lit(0.0))
        if us:
            within = within + F.coalesce(of(us).over(so_far(us, "down", F.desc("_t"), "_row")), F.lit(0.0))
        found[f"_sum_{c}"] = F.when(met, within).otherwise(F.lit(0.0))
    return union.withColumns(found).where("_row = 1").select("_own.*", *latest, *(F.col(f"_sum_{c}").alias(c) for c in sums))


def _cut(t: Column, n: int) -> Column:
    """t / n rounded down, in whole numbers."""
    return F.call_function("div", t, F.lit(n)) - F.when(t % n < 0, 1).otherwise(0)

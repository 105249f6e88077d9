"""Features of each event from the events before it, in one order per entity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessitura.operators.relations import in_order
from tessitura.operators.rolling import DAY_US, utc_day

BEFORE = (Window.unboundedPreceding, -1)


class Stream:
    """Names of the columns of an event stream. partition: who has a stream of their own; order: time and tie-breaker."""

    def __init__(self, partition: Sequence[str], time: str, tie: str, item: str, skipped: str) -> None:
        self.partition, self.time, self.tie, self.item, self.skipped = list(partition), time, tie, item, skipped

    def over(self, *more: str | Column) -> WindowSpec:
        return Window.partitionBy(*self.partition, *more).orderBy(self.time, self.tie)


def _count_before(w: WindowSpec) -> Column:
    return (F.row_number().over(w) - 1).cast("long")


def _since(time: str, w: WindowSpec) -> Column:
    """Seconds since the row before; null for the first."""
    at = F.unix_micros(F.col(time))
    return (at - F.lag(at).over(w)) / F.lit(1_000_000)


def sessionize(events: DataFrame, s: Stream, gap_seconds: float = 1800) -> DataFrame:
    """time_diff, session_id (from 0, a gap of more than gap_seconds starts the next), session_position, session_elapsed_seconds."""
    w = s.over()
    df = events.withColumn("time_diff", F.coalesce(_since(s.time, w), F.lit(0.0)))
    df = df.withColumn("session_id", F.sum(F.when(F.col("time_diff") > gap_seconds, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = s.over("session_id")
    return df.withColumn("session_position", _count_before(inside)).withColumn("session_elapsed_seconds", (F.unix_micros(s.time) - F.first(F.unix_micros(s.time)).over(inside)) / F.lit(1_000_000))


def calendar_parts(df: DataFrame, time: str) -> DataFrame:
    """hour, dow (Monday 0) and month in UTC, and their positions on a circle, rounded to 9 digits."""
    us, day = F.unix_micros(F.col(time).cast("timestamp")), utc_day(time)
    hour, dow = F.floor(F.pmod(us, F.lit(DAY_US)) / F.lit(3_600_000_000)).cast("int"), F.pmod(day + 3, F.lit(7))  # 1970-01-01 was a Thursday
    around = [(f"{n}_{f}", F.round(g(part * F.lit(6.283185307179586 / of)), 9)) for n, part, of in (("hour", hour, 24), ("dow", dow, 7)) for f, g in (("sin", F.sin), ("cos", F.cos))]
    return df.withColumns({"hour": hour, "dow": dow, "month": F.month(F.date_from_unix_date(day))} | dict(around))


def item_history(df: DataFrame, s: Stream) -> DataFrame:
    """Of the event's item before: play count, hours and plays since, skip rate (0 at first) and its Beta(1,1) mean."""
    w, row = s.over(s.item), F.col("row_idx")
    skip = F.col(s.skipped).cast("int")
    df = df.withColumn("row_idx", _count_before(s.over()))
    seen, skips = _count_before(w), F.coalesce(F.sum(skip).over(w.rowsBetween(*BEFORE)), F.lit(0))
    return df.withColumns(
        {
            "item_play_count": seen,
            "hours_since_item": F.coalesce(F.greatest(_since(s.time, w) / 3600, F.lit(0.0)), F.lit(0.0)),
            "plays_since_item": F.coalesce(row - F.lag(row).over(w), row + 1),
            "item_skip_rate": F.when(seen > 0, skips / seen).otherwise(0.0),
            "item_skip_smooth": (skips + 1) / (seen + 2),
        }
    )


def rolling_item_counts(df: DataFrame, s: Stream, windows: dict[str, int]) -> DataFrame:
    """Earlier events of the same item at most so many whole seconds ago, both ends included; ties count as earlier in order."""
    at = F.unix_seconds(s.time)
    own = Window.partitionBy(*s.partition, s.item).orderBy("at_s")
    df = df.withColumn("at_s", at).withColumn("so_far", _count_before(s.over(s.item)))
    counts = {n: F.col("so_far") - F.count(F.lit(1)).over(own.rangeBetween(Window.unboundedPreceding, -(sec + 1))) for n, sec in windows.items()}
    return df.withColumns(counts).drop("at_s", "so_far")


def streaks(df: DataFrame, s: Stream) -> DataFrame:
    """skip_streak and listen_streak: index within the run of like flags, from 0; 0 in runs of the other."""
    w, flag = s.over(), F.col(s.skipped).cast("int")
    df = df.withColumn("_run", F.sum(F.when(flag == F.lag(flag).over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = _count_before(s.over("_run"))
    return df.withColumns({"skip_streak": F.when(flag == 1, at).otherwise(F.lit(0).cast("long")), "listen_streak": F.when(flag == 0, at).otherwise(F.lit(0).cast("long"))}).drop("_run")


def session_so_far(df: DataFrame, s: Stream) -> DataFrame:
    """Within the session before the event: plays of its item, skip rate, different items, share of repeats, and whether the item repeats the one before."""
    w, one = s.over("session_id"), s.over("session_id", s.item)
    df = df.withColumn("item_session_plays", _count_before(one))
    skips = F.coalesce(F.sum(F.col(s.skipped).cast("int")).over(w.rowsBetween(*BEFORE)), F.lit(0))
    unique = F.coalesce(F.sum(F.when(F.col("item_session_plays") == 0, 1).otherwise(0)).over(w.rowsBetween(*BEFORE)), F.lit(0))
    at = F.col("session_position")
    return df.withColumns(
        {
            "session_skip_rate": F.when(at > 0, skips / at).otherwise(0.0),
            "session_unique_items": unique,
            "session_repeat_ratio": F.when(at > 0, (at - unique) / at).otherwise(0.0),
            "repeats_previous": F.coalesce((F.lag(s.item).over(w) == F.col(s.item)).cast("int"), F.lit(0)),
        }
    )


def transitions_so_far(df: DataFrame, s: Stream, vocabulary: int) -> DataFrame:
    """How often the step from the previous item in the session to this one was made before, and its smoothed rate."""
    df = df.withColumn("_from", F.lag(s.item).over(s.over("session_id")))
    again, out = _count_before(s.over("_from", s.item)), _count_before(s.over("_from"))
    known = F.col("_from").isNotNull()
    return df.withColumns({"transition_count": F.when(known, again).otherwise(0), "transition_rate": F.when(known, (again + 1) / (out + vocabulary)).otherwise(0.0)}).drop("_from")


def slot_rates(df: DataFrame, s: Stream) -> DataFrame:
    """Smoothed share of the item's earlier events in this hour of the day and day of the week."""
    seen = _count_before(s.over(s.item))
    return df.withColumns({f"item_{part}_rate": (_count_before(s.over(s.item, part)) + 1) / (seen + n) for part, n in (("hour", 24), ("dow", 7))})


def recent(df: DataFrame, s: Stream, lengths: Sequence[int] = (5, 20)) -> DataFrame:
    """Skip rate and share of different items over the k events before; 0 for the first event."""
    made = {}
    for k in lengths:
        w = s.over().rowsBetween(-k, -1)
        n = F.count(F.lit(1)).over(w)
        made[f"recent_skip_rate_{k}"] = F.coalesce(F.avg(F.col(s.skipped).cast("int")).over(w), F.lit(0.0))
        made[f"recent_unique_ratio_{k}"] = F.when(n > 0, F.size(F.collect_set(s.item).over(w)) / n).otherwise(0.0)
    return df.withColumns(made)


def codes(df: DataFrame, column: str, into: str) -> DataFrame:
    """Numbers from 0 for the values in order; null is -1. The distinct values are numbered, range by range, not the rows."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = in_order(values, [F.col(column)], into)
    return df.join(ranked, column, "left").withColumn(into, F.coalesce(into, F.lit(-1)))


def vocabulary(df: DataFrame, item: str, most: int) -> DataFrame:
    """(item, n, label): the most frequent items, of equal counts the smaller, labelled in order of name."""
    top = df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), item).limit(most)
    return top.withColumn("label", _count_before(Window.orderBy(item)))


def with_vocabulary(df: DataFrame, order: Sequence[Column], item: str, most: int, share: float = 1.0) -> DataFrame:
    """Rows whose item is among the `most` most frequent of the first share of the rows in a global order, with its label in order of name."""
    rows = in_order(df, order, "_at")
    n = rows.count()
    words = vocabulary(rows.where(F.col("_at") < math.floor(n * share)), item, most)
    return rows.join(words.select(item, "label"), item).drop("_at")


def item_frequency(df: DataFrame, order: Sequence[Column], item: str) -> DataFrame:
    """item_frequency: (earlier rows of the item + 1) / (earlier rows + different items), in one order over all rows, which is numbered range by range."""
    rows = in_order(df, order, "_at")
    size = df.select(item).distinct().count()
    seen = _count_before(Window.partitionBy(item).orderBy("_at"))
    return rows.withColumn("item_frequency", (seen + 1) / (F.col("_at") + size)).drop("_at")


def windows_before(df: DataFrame, s: Stream, length: int, carried: Sequence[str] = ()) -> DataFrame:
    """Training rows: the `length` items before an event of the same session, the event's item as target, and columns of the row before it."""
    w = s.over("session_id")
    rows = df.withColumn("history", F.collect_list(s.item).over(w.rowsBetween(-length, -1)))
    rows = rows.withColumns({f"before_{c}": F.lag(c).over(w) for c in carried})
    return rows.where(F.size("history") == length)


def example_histories(df: DataFrame, s: Stream, most: int) -> DataFrame:
    """Per event with an earlier one in its session: items and gaps before it (the first gap of the array 0), target gap, repeat, end of session."""
    w = s.over("session_id")
    frame = w.rowsBetween(-most, -1)
    rows = df.withColumn("history", F.collect_list(s.item).over(frame)).withColumn("_gaps", F.collect_list("time_diff").over(frame))
    rows = rows.withColumn("history_gaps", F.transform("_gaps", lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x))).drop("_gaps")
    rows = rows.withColumn("repeat", F.array_contains("history", F.col(s.item))).withColumn("session_end", F.lead(s.tie).over(w).isNull())
    return rows.where("session_position > 0")


def split_by_boundaries(df: DataFrame, s: Stream, shares: Sequence[float] = (0.64, 0.8)) -> DataFrame:
    """split (train, validation, test): cut at the session starts closest to the shares of each entity's rows, of equals the earlier."""
    w, whole = s.over(), Window.partitionBy(*s.partition)
    rows = df.withColumn("_at", _count_before(w)).withColumn("_n", F.count(F.lit(1)).over(whole))
    start = F.col("session_position") == 0
    for i, share in enumerate(shares):
        far = F.when(start & (F.col("_at") > 0), F.struct(F.abs(F.col("_at") - F.col("_n") * share).alias("d"), F.col("_at").alias("at")))
        rows = rows.withColumn(f"_cut{i}", F.coalesce(F.min(far).over(whole)["at"], F.col("_n")))
    name = F.when(F.col("_at") < F.col("_cut0"), "train").when(F.col("_at") < F.greatest("_cut0", "_cut1"), "validation").otherwise("test")
    return rows.withColumn("split", name).drop("_at", "_n", "_cut0", "_cut1")


def temporal_folds(rows: int, folds: int, least_train: int) -> list[tuple[int, int, int]]:
    """(fold, end of training, end of test) of expanding windows over row numbers."""
    size = (rows - least_train) // folds
    return [(k, least_train + k * size, least_train + (k + 1) * size) for k in range(folds)] if size > 0 else []

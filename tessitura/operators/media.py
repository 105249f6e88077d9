"""Events of several media in one form, their steps within sessions, and archetypes of days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import number, tri_state
from tessitura.operators.relations import quantiles

# How a play ended by its reason.
SKIPPED, COMPLETED = ("fwdbtn", "backbtn"), ("trackdone",)


def clean(c: Column) -> Column:
    """Text without blanks of any kind at its ends; blank, and the words nan, none and null, are null."""
    text = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(~F.lower(text).isin("", "nan", "none", "null"), text)


def skip_label(skipped: Column, reason_end: Column) -> Column:
    """What the flag says in any spelling, else what the reason says, else null."""
    reason = F.lower(F.trim(reason_end))
    return F.coalesce(tri_state(skipped), F.when(reason.isin(*SKIPPED), True).when(reason.isin(*COMPLETED), False))


def listen_ms(ms: Column) -> Column:
    """Whole milliseconds, halves to even; negative or no number is null."""
    value = number(ms)
    return F.when(value >= 0, F.bround(value).cast("long"))


def media_events(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """df with media_family, node_type, node_key, node_name, item_type, item_key and item_name; events of no medium are left out.

    columns: what the columns artist, track, track_uri, show, show_uri, episode, episode_uri, audiobook, audiobook_uri, chapter
    and chapter_uri are called; those that are missing are null. An audiobook comes before a show or episode, that before
    music. Keys are made of the URI, else of the name in lower case.
    """
    get = lambda n: clean(F.col(columns[n])) if n in columns else F.lit(None).cast("string")
    artist, track, show, episode, book, chapter = map(get, ("artist", "track", "show", "episode", "audiobook", "chapter"))
    uri = {n: get(f"{n}_uri") for n in ("track", "show", "episode", "audiobook", "chapter")}
    key = lambda kind, uri_, name: F.concat(kind, F.lit(":"), F.coalesce(uri_, F.lower(name)))
    none = F.lit(None).cast("string")

    def event(family: str, node_type: str, node: Column, node_uri: Column, item: Column, item_uri: Column, item_type: Column) -> Column:
        return F.struct(
            F.lit(family).alias("media_family"), F.lit(node_type).alias("node_type"), key(F.lit(node_type), node_uri, node).alias("node_key"), node.alias("node_name"),
            item_type.alias("item_type"), key(item_type, item_uri, item).alias("item_key"), item.alias("item_name"),
        )

    part = F.coalesce(chapter, episode, book)
    audio = event("audiobook", "audiobook", book, uri["audiobook"], part, F.coalesce(uri["chapter"], uri["episode"], uri["audiobook"]), F.when(F.lower(part) != F.lower(book), "chapter").otherwise("audiobook"))
    name = F.coalesce(show, episode, uri["episode"])
    podcast = event("podcast", "show", name, uri["show"], F.coalesce(episode, name), F.coalesce(uri["episode"], uri["show"]), F.when(episode.isNotNull(), "episode").otherwise("show"))
    who = F.coalesce(artist, track, uri["track"])
    music = event("music", "artist", who, none, F.coalesce(track, who), uri["track"], F.when(track.isNotNull(), "track").otherwise("artist"))
    made = F.when(book.isNotNull(), audio).when(name.isNotNull(), podcast).when(who.isNotNull(), music)
    return df.withColumn("_e", made).where("_e is not null").select(*df.columns, "_e.*")


def media_transitions(events: DataFrame, partition: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Steps between different nodes within a session: source and target with their families, whether they cross media, how many, and the time of the targets."""
    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.lag(F.struct("node_key", "node_name", "media_family")).over(w)
    steps = events.withColumn("_b", before).where("_b is not null and _b.node_key <> node_key")
    keys = {"source_key": "_b.node_key", "source_family": "_b.media_family", "target_key": "node_key", "target_family": "media_family"}
    g = steps.groupBy(*(F.col(c).alias(n) for n, c in keys.items())).agg(F.count(F.lit(1)).alias("transition_count"), F.sum("ms").alias("target_ms"))
    return g.withColumn("cross_media", F.col("source_family") != F.col("target_family"))


def day_features(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per day: streams, hours, and shares of skips, shuffle, offline, tracks and different artists."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    g = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_streams"), (F.sum("ms") / 3_600_000).alias("engagement_hours"), rate("skip").alias("skip_rate"), rate("shuffle").alias("shuffle_rate"), rate("offline").alias("offline_rate"), F.avg(F.col("track_uri").isNotNull().cast("double")).alias("track_stream_share"), F.count_distinct("artist").alias("_a")
    )
    return g.withColumn("exploration_ratio", F.col("_a") / F.col("total_streams")).withColumn("repeat_intensity", 1 - F.col("exploration_ratio")).drop("_a")


def archetypes(days: DataFrame) -> DataFrame:
    """archetype_label of each day: the first rule that holds, by exact quartiles of the days' features, which are joined as one row."""
    rows = days
    for name, column, q in (("skip_high", "skip_rate", 0.75), ("offline_high", "offline_rate", 0.75), ("exploration_high", "exploration_ratio", 0.75), ("shuffle_mid", "shuffle_rate", 0.5), ("repeat_mid", "repeat_intensity", 0.5), ("streams_low", "total_streams", 0.25)):
        rows = rows.join(F.broadcast(quantiles(days.select(column), column, [q]).select(F.col("q0").alias(f"_{name}"))))
    c = F.col
    label = (
        F.when(c("track_stream_share") <= 0.6, "mixed_media_reset")
        .when(c("offline_rate") >= F.greatest(F.lit(0.15), c("_offline_high")), "offline_binge")
        .when((c("skip_rate") >= c("_skip_high")) & (c("shuffle_rate") >= c("_shuffle_mid")), "skip_surfing")
        .when((c("exploration_ratio") >= c("_exploration_high")) & (c("shuffle_rate") >= c("_shuffle_mid")), "exploratory_shuffle")
        .when((c("repeat_intensity") >= c("_repeat_mid")) & (c("shuffle_rate") < c("_shuffle_mid")) & (c("skip_rate") < c("_skip_high")), "steady_replay")
        .when(c("total_streams") <= c("_streams_low"), "quick_check_in")
        .otherwise("steady_listening")
    )
    return rows.withColumn("archetype_label", label).select(*days.columns, "archetype_label")


def archetype_transitions(days: DataFrame, entity: Sequence[str], day: str) -> DataFrame:
    """(from_archetype, to_archetype, transition_count, transition_share) of an entity's days that follow each other."""
    w = Window.partitionBy(*entity).orderBy(day)
    steps = days.withColumn("to_archetype", F.lead("archetype_label").over(w)).where("to_archetype is not null")
    n = steps.groupBy(F.col("archetype_label").alias("from_archetype"), "to_archetype").agg(F.count(F.lit(1)).alias("transition_count"))
    total = n.agg(F.sum("transition_count").alias("_t"))
    return n.join(F.broadcast(total)).withColumn("transition_share", F.col("transition_count") / F.col("_t")).drop("_t")


def seasonal_summary(days: DataFrame, day: str) -> DataFrame:
    """Per season (December belongs to the winter of the next year) and archetype: days, their share of the season, means, first and last day."""
    month = F.month(day)
    season = F.when(month.isin(12, 1, 2), "winter").when(month <= 5, "spring").when(month <= 8, "summer").otherwise("fall")
    rows = days.withColumns({"season_year": F.year(day) + F.when(month == 12, 1).otherwise(0), "season": season})
    g = rows.groupBy("season_year", "season", "archetype_label").agg(F.count(F.lit(1)).alias("day_count"), F.avg("total_streams").alias("mean_streams"), F.avg("skip_rate").alias("mean_skip_rate"), F.avg("exploration_ratio").alias("mean_exploration_ratio"), F.min(day).alias("start_date"), F.max(day).alias("end_date"))
    return g.withColumn("archetype_share", F.col("day_count") / F.sum("day_count").over(Window.partitionBy("season_year", "season")))


def split_by_sessions(rows: DataFrame, entity: Sequence[str], session: str, train: float = 0.64, validation: float = 0.16) -> DataFrame:
    """split of each row, whole sessions at a time: cuts where the rows so far are closest to the shares (of equals the earlier), each part with a session.

    One session is train; of two the first is train, the second test. Only the sessions' sizes are ordered per entity.
    """
    sizes = rows.groupBy(*entity, session).agg(F.count(F.lit(1)).alias("_n"))
    w, whole = Window.partitionBy(*entity).orderBy(session), Window.partitionBy(*entity)
    s = sizes.withColumns({"_k": F.row_number().over(w), "_so_far": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(whole), "_sessions": F.count(F.lit(1)).over(whole)})
    near = lambda share, ok: F.min(F.when(ok, F.struct(F.abs(F.col("_so_far") - F.col("_all") * share).alias("d"), F.col("_k").alias("k")))).over(whole)["k"]
    s = s.withColumn("_cut", near(train, F.col("_k") <= F.col("_sessions") - 2))
    s = s.withColumn("_cut2", near(train + validation, (F.col("_k") > F.col("_cut")) & (F.col("_k") <= F.col("_sessions") - 1)))
    name = (
        F.when(F.col("_sessions") == 1, "train").when(F.col("_sessions") == 2, F.when(F.col("_k") == 1, "train").otherwise("test"))
        .when(F.col("_k") <= F.col("_cut"), "train").when(F.col("_k") <= F.col("_cut2"), "validation").otherwise("test")
    )
    return rows.join(s.select(*entity, session, name.alias("split")), [*entity, session])

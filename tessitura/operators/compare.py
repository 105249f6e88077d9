"""Comparisons of a listener's artists, tracks and podcasts with public ranked lists.

Entities: rows (day, dimension, key, name, detail, ms), one for each event and dimension it counts in. Public lists: rows
(scope, dimension, key, rank), a key standing once; of several the best rank. Within a group entities rank by events, then
time, then key; podcasts by time, then events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import name_key, similarity_label

DIMENSIONS = ("artists", "tracks", "podcasts")


def entities(events: DataFrame) -> DataFrame:
    """From listening events with day, media_type, artist, track, show (keys) and their names: one row per event and dimension."""
    music, podcast = F.col("media_type") == "music", F.col("media_type") == "podcast"
    row = lambda d, key, name, detail: F.struct(F.lit(d).alias("dimension"), key.alias("key"), name.alias("name"), detail.alias("detail"))
    none = F.lit("")
    made = F.array(
        F.when(music & (F.col("artist") != ""), row("artists", F.col("artist"), F.col("artist_name"), none)),
        F.when(music & (F.col("artist") != "") & (F.col("track") != ""), row("tracks", F.concat("track", F.lit("::"), "artist"), F.col("track_name"), F.col("artist_name"))),
        F.when(podcast & (F.col("show") != ""), row("podcasts", F.col("show"), F.col("show_name"), none)),
    )
    return events.select("day", "ms", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select("day", "ms", "e.*")


def public_ranks(lists: DataFrame, edition: int, most: int) -> DataFrame:
    """(scope, dimension, key, rank) of the first `most` rows of each list; a track stands under each of its artists."""
    rows = lists.where((F.col("edition") == edition) & (F.col("list_rank") <= most)).withColumn("_k", name_key(F.col("name")))
    artists = F.when(F.col("dimension") == "tracks", F.transform("artists", lambda a: F.concat(F.col("_k"), F.lit("::"), name_key(a)))).otherwise(F.array("_k"))
    keyed = rows.select(F.col("list_scope").alias("scope"), "dimension", F.explode(artists).alias("key"), F.col("list_rank").alias("rank"))
    return keyed.where("key <> '' and key not like '::%' and key not like '%::'").groupBy("scope", "dimension", "key").agg(F.min("rank").alias("rank"))


def ranked(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Entities per group and dimension: n, ms, a name and detail (of several the smallest), and place."""
    total = rows.groupBy(*group, "dimension", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"), F.min("name").alias("name"), F.min("detail").alias("detail"))
    podcast = F.col("dimension") == "podcasts"
    order = Window.partitionBy(*group, "dimension").orderBy(F.desc(F.when(podcast, F.col("ms")).otherwise(F.col("n"))), F.desc(F.when(podcast, F.col("n")).otherwise(F.col("ms"))), "key")
    return total.withColumn("place", F.row_number().over(order).cast("long"))


def against(mine: DataFrame, public: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """Each entity against each scope, with the public rank of its match."""
    each = mine.withColumn("scope", F.explode(F.array(*map(F.lit, scopes))))
    return each.join(public.select("scope", "dimension", "key", F.col("rank").alias("public_rank")), ["scope", "dimension", "key"], "left")


def _similarity(top: str, listed: str) -> Column:
    """Rank-weighted Jaccard of an array of (public_rank, place) and the sum of the list's weights. Of entities that match one public row the last counts."""
    places = F.col(top)
    hits = F.array_distinct(F.transform(F.filter(places, lambda x: x["public_rank"].isNotNull()), lambda x: x["public_rank"]))
    last = lambda r: F.array_max(F.transform(F.filter(places, lambda x: x["public_rank"] == r), lambda x: x["place"]))
    total = lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0.0), lambda s, x: s + x)
    both = total(hits, lambda r: F.least(1 / last(r), 1 / r))
    own = total(hits, lambda r: 1 / last(r)) + total(F.filter(places, lambda x: x["public_rank"].isNull()), lambda x: 1 / x["place"])
    return both / F.nullif(own + F.col(listed) - both, F.lit(0.0))


def comparison(mine: DataFrame, public: DataFrame, scopes: Sequence[str], group: Sequence[str], most: int) -> DataFrame:
    """Per group, scope and dimension: events, time, entities, shares on the public list, similarity of the first `most`, and the first entity."""
    rows = against(mine, public, scopes)
    hit, first = F.col("public_rank").isNotNull(), F.col("place") == 1
    keys = [*group, "scope", "dimension"]
    inside = F.col("place") <= most
    total = rows.groupBy(*keys).agg(
        F.sum("n").alias("event_count"), F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("unique_entity_count"), F.count_if(hit).alias("shared_public_entity_count"), F.count_if(hit & inside).alias("shared_top_count"), F.count_if(inside).alias("personal_top_count"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("_n"), F.sum(F.when(hit, F.col("ms")).otherwise(0)).alias("_ms"), F.collect_list(F.when(inside, F.struct("public_rank", "place"))).alias("_top"),
        *(F.max(F.when(first, F.col(c))).alias(f"personal_top_entity{n}") for c, n in (("name", ""), ("detail", "_detail"), ("public_rank", "_public_rank"))),
    )
    weight = public.select("scope", "dimension", "rank").distinct().groupBy("scope", "dimension").agg(F.sum(1 / F.col("rank")).alias("_listed"), F.count(F.lit(1)).alias("public_count"))
    found = total.join(weight, ["scope", "dimension"], "left").withColumn("_listed", F.coalesce("_listed", F.lit(0.0)))
    share = lambda part, whole: F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))
    found = found.withColumns({"event_share_on_public_top": share("_n", "event_count"), "duration_share_on_public_top": share("_ms", "ms"), "duration_minutes": F.col("ms") / 60_000, "rank_weighted_jaccard_similarity": F.coalesce(_similarity("_top", "_listed"), F.lit(0.0))})
    return found.drop("_n", "_ms", "_top", "_listed", "ms")


def daily_comparison(rows: DataFrame, public: DataFrame, scopes: Sequence[str], *, edition: int, window: tuple[str, str], most: int = 10) -> DataFrame:
    """A row for every day with an event, scope and dimension, zero-filled: comparison() with the list's edition, how the day lies to the list's window, and a label."""
    found = comparison(ranked(rows, ["day"]), public, scopes, ["day"], most)
    pairs = [F.struct(F.lit(s).alias("scope"), F.lit(d).alias("dimension")) for s in scopes for d in DIMENSIONS]
    grid = rows.select("day").distinct().select("day", F.explode(F.array(*pairs)).alias("p")).select("day", "p.*")
    counts = ["event_count", "unique_entity_count", "shared_public_entity_count"]
    shares = ["duration_minutes", "event_share_on_public_top", "duration_share_on_public_top", "rank_weighted_jaccard_similarity"]
    df = grid.join(found, ["day", "scope", "dimension"], "left").fillna(0, [*counts, *shares])
    begin, end = (F.lit(x).cast("date") for x in window)
    alignment = F.when(F.col("day") < begin, "historical_projection").when(F.col("day") > end, "post_window_projection").otherwise("date_aligned")
    label = F.when(F.col("event_count") > 0, similarity_label(F.col("rank_weighted_jaccard_similarity"))).otherwise("no personal data")
    return df.select(
        F.col("day").cast("string").alias("listening_date"), F.lit(edition).alias("reference_edition"), F.col("scope").alias("reference_scope"), F.when(F.col("scope") == "united_states", "US").alias("reference_country"), alignment.alias("reference_alignment"), "dimension",
        F.when(F.col("dimension") == "podcasts", "duration").otherwise("events").alias("ranking_basis"), *counts, *shares, label.alias("similarity_label"), "personal_top_entity", "personal_top_entity_detail", F.col("personal_top_entity_public_rank").cast("long").alias("personal_top_entity_public_rank"),
        F.concat(F.lit("public_listening_row/"), F.lit(edition), F.lit("/"), F.col("scope")).alias("public_source_url"),
    )


def daily_similarity_mart(daily: DataFrame) -> DataFrame:
    """daily_comparison() with both scopes side by side: similarities, their difference, the closer one, and shares."""
    one = ["reference_edition", "reference_alignment", "event_count", "duration_minutes", "unique_entity_count", "personal_top_entity", "personal_top_entity_detail"]
    measures = {"similarity": "rank_weighted_jaccard_similarity", "event_share_on_public_top": "event_share_on_public_top", "duration_share_on_public_top": "duration_share_on_public_top"}
    of = lambda scope, c: F.max(F.when(F.col("reference_scope") == scope, F.col(c)))
    wide = daily.groupBy("listening_date", "dimension").agg(*(of("global", c).alias(c) for c in one), *(of(s, c).alias(f"{s}_{n}") for n, c in measures.items() for s in ("global", "united_states")))
    g, u = F.col("global_similarity"), F.col("united_states_similarity")
    return wide.withColumns({"united_states_minus_global": u - g, "closer_scope": F.when(u == g, "tie").when(u > g, "united_states").otherwise("global")})


def scope_summary(per: DataFrame) -> DataFrame:
    """From comparison() over everything: per scope the mean similarity of its dimensions, its label, and whether the scope is the closest (of equals the first by name)."""
    mean = per.groupBy("scope").agg(F.avg("rank_weighted_jaccard_similarity").alias("overall_similarity"), F.count(F.lit(1)).alias("dimensions"))
    best = mean.agg(F.min_by("scope", F.struct((-F.col("overall_similarity")).alias("s"), F.col("scope").alias("n"))).alias("_best"))
    return mean.join(F.broadcast(best)).select("*", similarity_label(F.col("overall_similarity")).alias("overall_label"), (F.col("scope") == F.col("_best")).alias("closest")).drop("_best")


def monthly_alignment(rows: DataFrame, public: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """Per month, scope and dimension: events, minutes, and shares of both on entities of the public list."""
    per = rows.withColumn("month", F.date_format("day", "yyyy-MM")).groupBy("month", "dimension", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"))
    hit = F.col("public_rank").isNotNull()
    g = against(per, public, scopes).groupBy("month", "scope", "dimension").agg(F.sum("n").alias("events"), F.sum("ms").alias("ms"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("_n"), F.sum(F.when(hit, F.col("ms")).otherwise(0)).alias("_ms"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return g.select("month", "scope", "dimension", "events", (F.col("ms") / 60_000).alias("duration_minutes"), share("_n", "events").alias("event_share_on_public_top"), share("_ms", "ms").alias("duration_share_on_public_top"))


def lookback_comparison(recent: DataFrame, public: DataFrame, most: int) -> DataFrame:
    """(kind, name, key, plays, public_rank): of the `most` artists most heard those that the list has (shared) or not (distinctive), and artists of the list not heard at all (new).

    recent: rows (artist, artist_name); public: (key, rank, name).
    """
    heard = recent.groupBy("artist").agg(F.count(F.lit(1)).alias("plays"), F.min("artist_name").alias("name"))
    top = heard.orderBy(F.desc("plays"), "artist").limit(most).join(public.select(F.col("key").alias("artist"), "rank"), "artist", "left")
    mine = top.select(F.when(F.col("rank").isNotNull(), "shared").otherwise("distinctive").alias("kind"), "name", F.col("artist").alias("key"), "plays", F.col("rank").alias("public_rank"))
    new = public.join(heard.select(F.col("artist").alias("key")), "key", "left_anti").select(F.lit("new").alias("kind"), "name", "key", F.lit(0).cast("long").alias("plays"), F.col("rank").alias("public_rank"))
    return mine.unionByName(new)


def genre_share(music: DataFrame, tags: DataFrame, genres: DataFrame) -> DataFrame:
    """Per genre: events and minutes of artists with its tag, their shares of all music, and how much of all music has any tag.

    music: rows (artist, ms); tags: (artist, tag); genres: (genre, tag), a genre with each tag that means it.
    """
    per = music.groupBy("artist").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"))
    known = tags.select("artist").distinct().withColumn("tagged", F.lit(1))
    whole = per.join(known, "artist", "left").agg(F.sum("n").alias("_n"), F.sum("ms").alias("_ms"), F.sum(F.col("n") * F.coalesce("tagged", F.lit(0))).alias("_tn"), F.sum(F.col("ms") * F.coalesce("tagged", F.lit(0))).alias("_tms"))
    of = tags.join(genres, "tag").select("artist", "genre").distinct()
    g = per.join(of, "artist").groupBy("genre").agg(F.count(F.lit(1)).alias("artists"), F.sum("n").alias("events"), F.sum("ms").alias("ms"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    found = genres.select("genre").distinct().join(g, "genre", "left").fillna(0).join(F.broadcast(whole))
    return found.select("genre", "artists", "events", (F.col("ms") / 60_000).alias("duration_minutes"), share("events", "_n").alias("music_event_share"), share("ms", "_ms").alias("music_duration_share"), share("_tn", "_n").alias("tagged_event_share"), share("_tms", "_ms").alias("tagged_duration_share"))

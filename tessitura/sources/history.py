"""Listening exports: finding their files and reading them."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.scalars import content_type, truth
from tessitura.operators.rolling import utc_day

# File names and columns of the export format.
AUDIO_FILES, VIDEO_FILES = "Streaming_History_Audio_*.json", "Streaming_History_Video_*.json"
TECHNICAL_FILES = "ConnectionInfo.json AudioStreamingSettingsReport.json PlaybackError.json Stutter.json TrackNotPlayed.json CloudPlaybackPlaybackStats.json"
TECHNICAL_FOLDER = "technical log information"
TEXT_COLUMNS = "ts platform conn_country ip_addr master_metadata_track_name master_metadata_album_artist_name master_metadata_album_album_name episode_name episode_show_name audiobook_title audiobook_uri audiobook_chapter_uri audiobook_chapter_title reason_start reason_end shuffle skipped offline incognito_mode"
URI_COLUMNS = ("track_uri", "episode_uri")


def find_history_files(root: str, include_video: bool = False) -> list[str]:
    """Audio files of the one folder that has most of them (then: the root itself, a folder named like a history, the first by path), and its video files on request. None found raises."""
    groups: dict[Path, list[Path]] = defaultdict(list)
    for path in sorted(Path(root).rglob(AUDIO_FILES)):
        groups[path.parent].append(path)
    if not groups:
        raise FileNotFoundError(f"no {AUDIO_FILES} below {root}")
    best = min(groups, key=lambda p: (-len(groups[p]), p != Path(root), "history" not in p.name.lower(), str(p)))
    return [str(p) for p in groups[best] + (sorted(best.glob(VIDEO_FILES)) if include_video else [])]


def find_technical_files(root: str) -> dict[str, str]:
    """Path by name of the technical logs whose folder is named as such; of several the first by path."""
    found: dict[str, str] = {}
    for path in sorted(Path(root).rglob("*.json")):
        if path.name in TECHNICAL_FILES.split() and TECHNICAL_FOLDER in path.parent.name.lower():
            found.setdefault(path.name, str(path))
    return found


def event_schema(service: str) -> T.StructType:
    """Of the raw records; the service's name stands before the URI columns. Flags and numbers come as text and are cast later."""
    names = [*TEXT_COLUMNS.split(), *(f"{service}_{c}" for c in URI_COLUMNS), "ms_played", "offline_timestamp"]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_json_records(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Records of files that hold a JSON array each, one task per file; files that hold no records give none. `file` is the file's name."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(list(paths))
    present = F.coalesce(*(F.col(c) for c in schema.fieldNames())).isNotNull()
    return rows.where(F.col("_broken").isNull() & present).drop("_broken").withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))


def read_history(spark: SparkSession, paths: Sequence[str], service: str) -> DataFrame:
    """Typed events: flags boolean, numbers long, ts kept as text; addresses dropped."""
    raw = read_json_records(spark, paths, event_schema(service)).drop("ip_addr")
    flags = {c: truth(F.col(c)) for c in ("shuffle", "skipped", "offline", "incognito_mode")}
    numbers = {c: F.col(c).try_cast("long") for c in ("ms_played", "offline_timestamp")}
    return raw.withColumns(flags | numbers).withColumnsRenamed({f"{service}_{c}": c for c in URI_COLUMNS})


def bronze_history(events: DataFrame) -> DataFrame:
    """Events with a readable time: played_at (UTC), year, month, content_type (track, if there is no column of URIs at all); ts dropped."""
    rows = events.withColumn("played_at", F.try_to_timestamp("ts")).where("played_at is not null").drop("ts")
    named = {"audiobook": ["audiobook_uri", "audiobook_chapter_uri"], "episode": ["episode_uri"], "track": ["track_uri"]}
    there = {n: [F.nullif(F.trim(c), F.lit("")) for c in cs if c in rows.columns] for n, cs in named.items()}
    uris = {n: F.coalesce(*cs) for n, cs in there.items() if cs}
    day = F.date_from_unix_date(utc_day("played_at"))
    return rows.withColumns({"year": F.year(day), "month": F.month(day), "content_type": content_type(**uris) if uris else F.lit("track")})


def load_history(spark: SparkSession, root: str, service: str, include_video: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """The history below a folder, and how many files, bytes and records it has; no records raise."""
    paths = find_history_files(root, include_video)
    events = read_history(spark, paths, service)
    stats = {"files": len(paths), "bytes": file_sizes(paths), "records": events.count()}
    if not stats["records"]:
        raise ValueError(f"no records below {root}")
    return events, stats


def file_sizes(paths: Sequence[str]) -> int:
    return sum(os.path.getsize(p) for p in paths)

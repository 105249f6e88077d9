"""Public interaction and item files in one canonical form."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.operators.quality import violations
from tessitura.sources.shapes import align, resolve_columns, two_row_header

_S, _D = T.StringType(), T.DoubleType()
_struct = lambda **kinds: T.StructType([T.StructField(n, k) for n, k in kinds.items()])
INTERACTIONS = _struct(source_dataset=_S, user_id=_S, session_id=_S, item_id=_S, timestamp=T.TimestampType(), event_type=_S, interaction_value=_D, dwell_ms=_D, reward=_D, propensity=_D, position=T.LongType(), explicit_positive=T.BooleanType(), policy_id=_S, split=_S, context_json=_S)
ITEMS = _struct(source_dataset=_S, item_id=_S, artist_id=_S, album_id=_S, item_name=_S, artist_name=_S, album_name=_S, genres=_S, duration_ms=_D, audio_path=_S, content_license=_S, metadata_json=_S)


@dataclass(frozen=True)
class Format:
    """How a dataset's files look. aliases: canonical name -> names in the files, tried in order. time: s, ms or auto. scale: factors."""

    dataset: str
    aliases: Mapping[str, Sequence[str]]
    required: Sequence[str]
    separator: str = ","
    header: Sequence[str] | None = None
    header_rows: int = 1
    time: str = "auto"
    scale: Mapping[str, float] = field(default_factory=dict)
    constant: Mapping[str, str] = field(default_factory=dict)


# The layouts of six public datasets.
TASTE_PROFILE = Format("taste_profile", {"user_id": ["user"], "item_id": ["song"], "interaction_value": ["plays", "play_count"]}, ["user_id", "item_id", "interaction_value"], "\t", ["user", "song", "plays"], constant={"event_type": "play_count", "explicit_positive": "true"})
LISTENING_LOGS = Format("listening_logs", {"user_id": ["user"], "timestamp": ["time"], "item_id": ["track_id", "track"], "artist_id": ["artist"], "album_id": ["album"]}, ["user_id", "item_id", "timestamp"], "\t", ["user_id", "artist_id", "album_id", "track_id", "timestamp"], time="s", constant={"event_type": "listen"})
PLAY_EVENTS = Format("play_events", {"user_id": ["user"], "item_id": ["song", "track_id"], "timestamp": ["time"], "interaction_value": ["count", "plays"]}, ["user_id", "item_id"], "\t", constant={"event_type": "listen"})
TRACK_TABLE = Format("track_table", {"item_id": ["track_id", "id"], "item_name": ["track_title", "title"], "artist_name": ["artist"], "album_name": ["album_title"], "genres": ["track_genres", "genre"], "duration_ms": ["track_duration", "duration"]}, ["item_id"], header_rows=2, scale={"duration_ms": 1000.0})
POLICY_LOGS = Format("policy_logs", {"user_id": ["user"], "item_id": ["video_id", "item"], "timestamp": ["time_ms"], "dwell_ms": ["play_time_ms"], "reward": ["is_click", "click"], "explicit_positive": ["is_like"]}, ["user_id", "item_id"], time="ms", constant={"event_type": "exposure"})
BANDIT_LOGS = Format("bandit_logs", {"item_id": ["item"], "timestamp": ["time"], "position": [], "reward": ["click"], "propensity": ["propensity_score", "action_prob"]}, ["item_id", "reward", "propensity"], constant={"event_type": "impression"})


def read_text_table(spark: SparkSession, path: str, form: Format) -> DataFrame:
    """All columns as text; split over tasks like any CSV (two header rows are read on the driver, their lines dropped)."""
    read = spark.read.option("sep", form.separator).option("mode", "DROPMALFORMED")
    if form.header_rows == 2:
        with open(path, encoding="utf-8") as f:
            first, second = (f.readline().rstrip("\r\n").split(form.separator) for _ in range(2))
        names = two_row_header(first, second)
        rows = read.schema(T.StructType([T.StructField(n, _S) for n in names])).csv(path)
        heads = (F.coalesce(F.col(names[0]), F.lit("")) == first[0]) & (F.coalesce(F.col(names[-1]), F.lit("")) == first[-1]) | (F.coalesce(F.col(names[0]), F.lit("")) == second[0]) & (F.coalesce(F.col(names[-1]), F.lit("")) == second[-1])
        return rows.where(~heads)
    if form.header is not None:
        return read.schema(T.StructType([T.StructField(n, _S) for n in form.header])).csv(path)
    return read.option("header", True).csv(path)


def time_column(df: DataFrame, column: str, unit: str) -> Column:
    """UTC time from epochs or text; auto: numbers if at least nine of ten are, in ms if their median is at least 1e11."""
    number = F.col(column).try_cast("double")
    if unit == "auto":
        seen = df.agg(F.avg(F.when(F.col(column).isNotNull(), number.isNotNull().cast("int"))).alias("share"), F.median(F.abs(number)).alias("middle")).first()
        unit = "text" if (seen["share"] or 0) < 0.9 else "ms" if seen["middle"] >= 1e11 else "s"
    return F.try_to_timestamp(column) if unit == "text" else F.timestamp_micros((number * (1_000 if unit == "ms" else 1_000_000)).cast("long"))


def canonical(df: DataFrame, form: Format, schema: T.StructType, extra: str, explicit: Mapping[str, str] | None = None) -> DataFrame:
    """The schema's columns; columns that no name takes come as JSON in `extra`."""
    found = resolve_columns(df.columns, form.aliases, form.required, explicit)
    taken = {n: F.col(c) for n, c in found.items() if n in schema.fieldNames()}
    for n, c in found.items():
        if n == "timestamp":
            taken[n] = time_column(df, c, form.time)
        elif n in form.scale:
            taken[n] = F.col(c).try_cast("double") * form.scale[n]
    left = [c for c in df.columns if c not in {found[n] for n in taken}]
    rest = F.to_json(F.struct(*sorted(left)), {"ignoreNullFields": "false"}) if left else F.lit("{}")
    rows = df.select(F.lit(form.dataset).alias("source_dataset"), *(v.alias(n) for n, v in taken.items()), *(F.lit(v).alias(n) for n, v in form.constant.items() if n in schema.fieldNames()), rest.alias(extra))
    return align(rows, schema)


def read_interactions(spark: SparkSession, path: str, form: Format, explicit: Mapping[str, str] | None = None) -> DataFrame:
    return canonical(read_text_table(spark, path, form), form, INTERACTIONS, "context_json", explicit)


def read_items(spark: SparkSession, path: str, form: Format, explicit: Mapping[str, str] | None = None) -> DataFrame:
    return canonical(read_text_table(spark, path, form), form, ITEMS, "metadata_json", explicit)


def check_interactions(df: DataFrame) -> DataFrame:
    blank = lambda c: f"trim(coalesce({c}, '')) <> ''"
    return violations(df, {"source_dataset": blank("source_dataset"), "item_id": blank("item_id"), "propensity": "propensity is null or (propensity > 0 and propensity <= 1)", "dwell_ms": "dwell_ms is null or dwell_ms >= 0"})


def check_items(df: DataFrame) -> DataFrame:
    return violations(df, {"item_id": "trim(coalesce(item_id, '')) <> ''", "duration_ms": "duration_ms is null or duration_ms >= 0"})


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def check_manifest(manifest: Mapping, root: str) -> None:
    """Approved, and every file of the size and hash it names; else raises."""
    if not manifest.get("approved"):
        raise ValueError("the source isn't approved")
    for entry in manifest.get("files", []):
        path = Path(root, entry["path"])
        if path.stat().st_size != entry["bytes"] or file_sha256(str(path)) != entry["sha256"]:
            raise ValueError(f"{entry['path']} is not the file named in the manifest")

"""Streams of listening events: sessions, counters, and events applied once in order of version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessitura.sources import files

RESULT = "session_id string, event_id string, version long, outcome string"
STATE = "version long, payloads map<string,string>"


def stream_sessions(events: DataFrame, entity: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by inactivity; a gap of exactly `gap` does not end one. In append mode a session comes out once the watermark has passed it."""
    window = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(entity, window.alias("w")).agg(F.count(F.lit(1)).alias("event_count"), F.max(time).alias("last")).select(entity, F.col("w.start").alias("start"), F.col("last").alias("end"), "event_count")


def apply_versions(events: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Events (session_id, event_id, expected_version long, payload) applied one by one per session.

    outcome: applied (the session's version rises by one), replayed (same event and payload again), conflict (same
    event, other payload) or stale (expected_version isn't the session's). A session's events of one trigger are put in
    order of expected_version and event_id whole, however Arrow batches cut them. The state keeps a digest of each
    payload; with timeout_ms it goes that long after the session's last event, in processing time (the stream then runs
    batches without data).
    """

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, payloads = (state.get[0], dict(state.get[1])) if state.exists else (0, {})
        outcomes = []
        now = pd.concat(list(frames), ignore_index=True).sort_values(["expected_version", "event_id"], kind="stable")
        for event, expected, payload in zip(now["event_id"], now["expected_version"], now["payload"]):
            digest = "" if payload is None else sha256(payload.encode()).hexdigest()
            if event in payloads:
                outcome = "replayed" if payloads[event] == digest else "conflict"
            elif expected != version:
                outcome = "stale"
            else:
                version, outcome = version + 1, "applied"
                payloads[event] = digest
            outcomes.append((key[0], event, version, outcome))
        state.update((version, payloads))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(outcomes, columns=["session_id", "event_id", "version", "outcome"])

    kind = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("session_id").applyInPandasWithState(apply, RESULT, STATE, "append", kind)


def unique_events(events: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Each (session_id, event_id) once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["session_id", "event_id"])


def feedback_counters(events: DataFrame) -> DataFrame:
    """Per artist_key: likes, repeats, skips, dislikes and the last signal; update or complete mode."""
    count = lambda s: F.count_if(F.col("signal") == s).alias(f"{s}s")
    return events.groupBy("artist_key").agg(count("like"), count("repeat"), count("skip"), count("dislike"), F.max_by("signal", F.struct("ts", "event_id")).alias("last_signal"))


def upsert_batches(keys: list[str], order: str, path: str, buckets: int = 64):
    """For foreachBatch: keeps, below a folder, the latest row of each key; upserted() reads it.

    Rows lie in buckets by a hash of their keys, and a batch writes anew only the buckets that it touches, beside the
    old ones. The file `current` names the folder of every bucket and the last batch, and is replaced in one step: a
    batch that died half-way has changed nothing and is applied again, one that was applied changes nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = _current(spark, path)
        if number <= state["batch"]:
            return
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
        old = [state["folders"][str(b)] for b in touched if str(b) in state["folders"]]
        if old:
            rows = rows.unionByName(spark.read.schema(rows.schema).option("basePath", path).parquet(*old))
        values = F.struct(*[c for c in batch.columns if c not in keys])
        latest = rows.groupBy("_bucket", *keys).agg(F.max_by(values, order).alias("_r"))
        folder = f"{path}/batch-{number}-{uuid.uuid4().hex}"
        latest.select("_bucket", *keys, "_r.*").select(*rows.columns).write.partitionBy("_bucket").parquet(folder)
        folders = state["folders"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
        files.replace_text(spark, f"{path}/current", json.dumps({"batch": number, "schema": batch.schema.json(), "folders": folders}))
        for gone in old:
            files.delete(spark, gone)

    return upsert


def _current(spark: SparkSession, path: str) -> dict:
    text = files.read_text(spark, f"{path}/current")
    return json.loads(text) if text else {"batch": -1, "folders": {}}


def upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that upsert_batches() keeps; None before its first batch."""
    state = _current(spark, path)
    if not state["folders"]:
        return None
    schema = T.StructType.fromJson(json.loads(state["schema"]))
    return spark.read.schema(schema).parquet(*state["folders"].values())


def recent(table: DataFrame, time: str, ident: str, most: int) -> DataFrame:
    return table.orderBy(F.desc(time), F.desc(ident)).limit(most)

"""Technical logs of an export, and what they tell of each play."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.scalars import device_family, epoch_ms, number, truth
from tessitura.operators.timejoin import augment_in_blocks
from tessitura.sources.history import TECHNICAL_FILES, find_technical_files, read_json_records

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
# Fields of the logs' records, and the columns made of them.
FIELDS = "context_time timestamp_utc message_client_timestamp context_device_type context_os_name context_device_model message_reachability_type message_ipv6_failed message_allow_downgrade message_user_selected_play_bitrate_wifi message_play_bitrate_wifi message_user_selected_play_bitrate_cellular message_play_bitrate_cellular message_fatal message_num_stalls"
COLUMNS = (
    "tech_connection_events_1h tech_connection_none_24h tech_ipv6_failures_24h tech_playback_errors_24h tech_playback_fatal_errors_24h tech_stutter_events_24h tech_track_not_played_24h tech_cloud_stats_events_24h tech_cloud_stalls_24h "
    "tech_last_reachability_wifi tech_last_reachability_cellular tech_last_reachability_offline tech_last_ipv6_failed tech_allow_downgrade tech_bitrate_wifi_kbps tech_bitrate_cellular_kbps"
).split()


def read_technical_logs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The logs that lie below a folder, by name, all fields as text."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in FIELDS.split()])
    return {name: read_json_records(spark, [path], schema) for name, path in find_technical_files(root).items()}


def _events(log: DataFrame, values: Mapping[str, Column], family: bool = True) -> DataFrame:
    """Time, family and values of the records that have a time; of equal times the later record is last."""
    get = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in log.columns), F.lit(None).cast("string"))
    times = [n for n in ("context_time", "timestamp_utc", *([] if family else ["message_client_timestamp"])) if n in log.columns]
    ms = epoch_ms(F.col(times[0]) if len(times) == 1 and dict(log.dtypes)[times[0]] in ("int", "bigint") else get(*times))
    device = device_family(F.lower(get("context_device_type", "context_os_name", "context_device_model"))) if family else F.lit("all")
    seq = F.col("event_id").cast("long") if "event_id" in log.columns else F.monotonically_increasing_id()
    return log.select((ms * 1000).alias("time_us"), device.alias("family"), seq.alias("seq"), *(v.alias(n) for n, v in values.items())).where("time_us is not null")


def technical_features(plays: DataFrame, ident: str, time: str, platform: str, logs: Mapping[str, DataFrame]) -> DataFrame:
    """plays with the sixteen COLUMNS: counts of events of the device's family in the hour or day before a play, ends included, and the
    latest reports at or before it; of cloud statistics regardless of the family. A log that is missing gives 0.

    All logs by family are joined in one union, the cloud statistics in another, both by family and day: tasks grow with the days,
    not with a family. Connection and settings reports, and plays, are read twice.
    """
    flag = lambda log, c: F.coalesce(truth(F.col(c)).cast("double"), F.lit(0.0)) if c in log.columns else F.lit(0.0)
    value = lambda log, *cs: F.coalesce(*(number(F.col(c)) for c in cs if c in log.columns), F.lit(0.0))
    one = {"n": F.lit(1.0)}
    sources: dict[str, DataFrame] = {}
    latest: dict[str, tuple[str, str]] = {}
    sums: dict[str, tuple[str, str, int]] = {}
    for name in TECHNICAL_FILES.split():
        log = logs.get(name)
        if log is None:
            continue
        key = name.split(".")[0]
        if key == "ConnectionInfo":
            kind = F.lower(F.trim(F.coalesce(F.col("message_reachability_type"), F.lit("")))) if "message_reachability_type" in log.columns else F.lit("")
            made = {"wifi": kind.rlike("wlan|wifi"), "cellular": kind.rlike("2g|3g|4g|5g|cell"), "offline": kind.isin("none", "offline", "unreachable")}
            sources[key] = _events(log, one | {n: c.cast("double") for n, c in made.items()} | {"ipv6": flag(log, "message_ipv6_failed")})
            sums |= {"tech_connection_events_1h": (key, "n", HOUR_US), "tech_connection_none_24h": (key, "offline", DAY_US), "tech_ipv6_failures_24h": (key, "ipv6", DAY_US)}
            latest |= {f"tech_last_reachability_{n}": (key, n) for n in made} | {"tech_last_ipv6_failed": (key, "ipv6")}
        elif key == "AudioStreamingSettingsReport":
            rate = lambda kind, log=log: value(log, f"message_user_selected_play_bitrate_{kind}", f"message_play_bitrate_{kind}") / 1000
            sources[key] = _events(log, {"downgrade": flag(log, "message_allow_downgrade"), "wifi": rate("wifi"), "cellular": rate("cellular")})
            latest |= {"tech_allow_downgrade": (key, "downgrade"), "tech_bitrate_wifi_kbps": (key, "wifi"), "tech_bitrate_cellular_kbps": (key, "cellular")}
        elif key in ("PlaybackError", "Stutter", "TrackNotPlayed"):
            sources[key] = _events(log, one | ({"fatal": flag(log, "message_fatal")} if key == "PlaybackError" else {}))
            sums[{"PlaybackError": "tech_playback_errors_24h", "Stutter": "tech_stutter_events_24h", "TrackNotPlayed": "tech_track_not_played_24h"}[key]] = (key, "n", DAY_US)
            if key == "PlaybackError":
                sums["tech_playback_fatal_errors_24h"] = (key, "fatal", DAY_US)
    rows = plays.withColumns({"_us": F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1000).cast("long") * 1000, "family": device_family(F.lower(F.col(platform))), "_all": F.lit("all")})
    if sources:
        rows = augment_in_blocks(rows, sources, ["family"], ident, "_us", latest=latest, sums=sums)
    cloud = logs.get("CloudPlaybackPlaybackStats.json")
    if cloud is not None:
        events = _events(cloud, one | {"stalls": value(cloud, "message_num_stalls")}, family=False).withColumnRenamed("family", "_all")
        rows = augment_in_blocks(rows, {"cloud": events}, ["_all"], ident, "_us", latest={}, sums={"tech_cloud_stats_events_24h": ("cloud", "n", DAY_US), "tech_cloud_stalls_24h": ("cloud", "stalls", DAY_US)})
    return rows.withColumns({c: F.lit(0.0) for c in COLUMNS if c not in rows.columns}).drop("_us", "_all")

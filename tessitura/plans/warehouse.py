"""A warehouse of named tables in layers: built lazily in order, written only if changed, with lineage and checks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators import quality, relations, similarity
from tessitura.operators.gaptree import gap_sessions
from tessitura.plans import history as clean
from tessitura.plans.mart_queries import daily_activity, daily_similarity
from tessitura.sources import files
from tessitura.tables import table

Build = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Asset:
    name: str
    layer: str
    upstream: Sequence[str]
    build: Build


def in_build_order(assets: Sequence[Asset]) -> list[Asset]:
    """Each after what it comes from; an unknown or circular upstream raises."""
    known, done, out = {a.name: a for a in assets}, set(), []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in done:
            return
        if name in path or name not in known:
            raise ValueError(f"{' > '.join((*path, name))}: circular or unknown")
        for u in known[name].upstream:
            visit(u, (*path, name))
        done.add(name)
        out.append(known[name])

    for a in assets:
        visit(a.name, ())
    return out


def edges(assets: Sequence[Asset]) -> list[tuple[str, str]]:
    return sorted((u, a.name) for a in assets for u in a.upstream)


def reach(assets: Sequence[Asset], name: str, down: bool) -> list[str]:
    """All tables below (or above) one."""
    step = [(a, b) if down else (b, a) for a, b in edges(assets)]
    found: set[str] = set()
    todo = [name]
    while todo:
        now = todo.pop()
        new = [b for a, b in step if a == now and b not in found]
        found.update(new)
        todo += new
    return sorted(found)


def decision(before: Mapping | None, there: bool, content: Mapping) -> tuple[str, str]:
    """(what is done, why) with a table whose content hash is known."""
    if before is None:
        return "built", "new_asset"
    if not there:
        return "rebuilt", "file_missing"
    return ("reused", "content_unchanged") if before["content"] == dict(content) else ("rebuilt", "content_changed")


class Warehouse:
    """Tables under root/layer/name/version and root/manifest.json, which names the version of each that counts.

    A refresh writes new versions beside the old ones and then replaces the manifest in one step, so a refresh that
    dies leaves the warehouse as it was.
    """

    def __init__(self, root: str, assets: Sequence[Asset]) -> None:
        self.root, self.assets = root, in_build_order(assets)

    def path(self, a: Asset) -> str:
        return f"{self.root}/{a.layer}/{a.name}"

    def manifest(self, spark: SparkSession) -> dict:
        text = files.read_text(spark, f"{self.root}/manifest.json")
        return json.loads(text) if text else {"assets": {}}

    def _places(self, spark: SparkSession) -> dict[str, str]:
        """Folder by name of the tables that are there."""
        found = self.manifest(spark)["assets"]
        places = {a.name: f"{self.path(a)}/{found[a.name]['version']}" for a in self.assets if a.name in found}
        return {n: p for n, p in places.items() if files.exists(spark, p)}

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {n: spark.read.parquet(p) for n, p in self._places(spark).items()}

    def refresh(self, spark: SparkSession) -> dict:
        """Build all tables, each from what was written of those before it; keep the version of those whose content is the same."""
        before, places, done, built = self.manifest(spark)["assets"], self._places(spark), {}, {}
        for a in self.assets:
            df = a.build(built)
            version = f"v-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path(a)}/{version}")
            written = spark.read.schema(df.schema).parquet(f"{self.path(a)}/{version}")
            content = {k: str(v) for k, v in quality.content_hash(written).first().asDict().items()} | {"schema": df.schema.simpleString()}
            what, why = decision(before.get(a.name), a.name in places, content)
            if what == "reused":
                files.delete(spark, f"{self.path(a)}/{version}")
                version = before[a.name]["version"]
            built[a.name] = spark.read.schema(df.schema).parquet(f"{self.path(a)}/{version}")
            lineage = {"upstream": list(a.upstream), "downstream": reach(self.assets, a.name, True)}
            done[a.name] = {"layer": a.layer, "version": version, "rows": int(content["rows"]), "content": content, "decision": what, "reason": why} | lineage
        rows = {n: x["rows"] for n, x in done.items()}
        found = quality.row_count_findings(rows, {n: x["rows"] for n, x in before.items()}, {a.name: a.upstream for a in self.assets})
        manifest = {"assets": done, "edges": edges(self.assets), "findings": found}
        files.replace_text(spark, f"{self.root}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True))
        for a in self.assets:
            for old in files.names(spark, self.path(a)):
                if old != done[a.name]["version"]:
                    files.delete(spark, f"{self.path(a)}/{old}")
        return manifest

    def verify(self, spark: SparkSession) -> dict[str, list[str]]:
        """Differences between the manifest and the files, by table; none for a sound warehouse."""
        out, places = {}, self._places(spark)
        for name, x in self.manifest(spark)["assets"].items():
            if name not in places:
                out[name] = ["missing"]
                continue
            content = {k: str(v) for k, v in quality.content_hash(spark.read.parquet(places[name])).first().asDict().items()}
            wrong = [f"{k} is {content[k]}, not {x['content'][k]}" for k in content if content[k] != x["content"][k]]
            if wrong:
                out[name] = wrong
        return out

    def register(self, spark: SparkSession) -> list[str]:
        """Temporary views of all tables that are there."""
        found = self.tables(spark)
        for name, df in found.items():
            df.createOrReplaceTempView(name)
        return sorted(found)


def listening_assets(spark: SparkSession, folder: str) -> list[Asset]:
    """Bronze, silver and gold tables over a data folder."""
    src = lambda name: lambda _: table(spark, folder, name)
    return [
        Asset("listening_events", "bronze", [], lambda _: clean.history(spark, folder)),
        Asset("public_lists", "bronze", [], src("public_listening_row")),
        Asset("opportunities", "bronze", [], lambda _: table(spark, folder, "creator_ranking_opportunities").dropDuplicates(["opportunity_id"])),
        Asset("daily_activity", "silver", ["listening_events"], lambda t: daily_activity(t["listening_events"])),
        Asset("daily_similarity", "silver", ["listening_events", "public_lists"], lambda t: daily_similarity(t["listening_events"], t["public_lists"])),
        Asset("sessions", "silver", ["listening_events"], lambda t: gap_sessions(t["listening_events"], "user_id", "ts", "event_id", "artist_key")),
        Asset("scene_summary", "silver", ["opportunities"], lambda t: t["opportunities"].where("scene_name is not null").groupBy("scene_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("artist_name").alias("artists"), F.round(F.avg(F.nanvl("opportunity_score", F.lit(None))), 6).alias("mean_score"), F.count_if(F.col("opportunity_band") == "priority_now").alias("priority_now"))),
        Asset("similarity_trend", "gold", ["daily_similarity"], lambda t: similarity.closer_streaks(similarity.trailing_trend(t["daily_similarity"], [], "day", "global"), [], "day", "global", "united_states", ("global", "united_states"))),
        Asset("similarity_anomalies", "gold", ["daily_similarity"], lambda t: similarity.deviations(t["daily_similarity"], [], "day", "global").where("is_anomaly")),
        Asset("top_scene_artist", "gold", ["opportunities"], lambda t: relations.top_one(t["opportunities"].where("scene_name is not null and not isnan(opportunity_score)"), ["scene_name"], F.desc_nulls_last("opportunity_score"), F.asc("opportunity_id")).select("scene_name", "artist_name", "opportunity_score")),
    ]

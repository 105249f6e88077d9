"""Charts and tags of artists behind a web service, and a cache of tags."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.scalars import name_key
from tessitura.sources.paged import PagedClient

CHART = "rank long, name string, playcount long, listeners long, url string"


class ChartClient:
    """Charts by a polite client: get(url) answers with the document. base: the service's address; method names are parameters."""

    def __init__(self, client: PagedClient, base: str) -> None:
        self.client, self.base = client, base

    def _rows(self, path: Sequence[str], **query: object) -> Iterator[dict]:
        document = self.client.get(f"{self.base}?{urlencode(sorted(query.items()))}")
        for key in path:
            document = document.get(key) if isinstance(document, dict) else None
        if not isinstance(document, list):
            raise ValueError(f"no list at {'.'.join(path)}")
        return (x for x in document if isinstance(x, dict) and str(x.get("name") or "").strip())

    def top_artists(self, spark: SparkSession, limit: int = 50, page: int = 1, country: str | None = None) -> DataFrame:
        query = {"method": "geo" if country else "chart", "limit": max(1, limit), "page": max(1, page)} | ({"country": country} if country else {})
        return self._chart(spark, self._rows(["topartists" if country else "artists", "artist"], **query))

    def artists_of_tag(self, spark: SparkSession, tag: str, limit: int = 50) -> DataFrame:
        if not tag.strip():
            raise ValueError("a blank tag")
        return self._chart(spark, self._rows(["topartists", "artist"], method="tag", tag=tag.strip(), limit=max(1, limit)))

    def tags_of_artist(self, artist: str) -> list[str]:
        return [str(x["name"]).strip() for x in self._rows(["toptags", "tag"], method="artist_tags", artist=artist.strip())]

    def _chart(self, spark: SparkSession, rows: Iterator[dict]) -> DataFrame:
        """Rank as told, else by position; numbers that are none are null."""

        def whole(x: object) -> int | None:
            try:
                return int(str(x))
            except ValueError:
                return None

        made = []
        for i, x in enumerate(rows, 1):
            about = x.get("@attr")
            told = whole(about.get("rank")) if isinstance(about, dict) else None
            made.append((told or i, str(x["name"]).strip(), whole(x.get("playcount")), whole(x.get("listeners")), str(x.get("url") or "").strip()))
        return spark.createDataFrame(made, CHART)


class TagCache:
    """Tags by artist in a Parquet folder that any cluster shares: rows are added, the latest of a key counts for ttl_s seconds."""

    def __init__(self, path: str, ttl_s: float = 7 * 86_400, namespace: str = "artist-tags-v1", clock: Callable[[], float] = time.time) -> None:
        if ttl_s < 0:
            raise ValueError("a negative time to live")
        self.path, self.ttl_s, self.namespace, self.clock = path, ttl_s, namespace.strip(), clock

    def keyed(self, artists: DataFrame, artist: str) -> DataFrame:
        """artists with `key`: the digest of namespace and plain name, the same for spellings of one name."""
        return artists.withColumn("key", F.sha2(F.concat(F.lit(f"{self.namespace}:"), name_key(F.col(artist))), 256))

    def put(self, tags: DataFrame, artist: str) -> None:
        """tags: (artist, tags array<string>); blank ones are left out, repeated ones count once."""
        clean = F.array_distinct(F.filter(F.transform("tags", lambda x: F.trim(x)), lambda x: x != ""))
        self.keyed(tags, artist).select("key", F.lit(float(self.clock())).alias("cached_at"), clean.alias("tags")).write.mode("append").parquet(self.path)

    def get(self, artists: DataFrame, artist: str) -> DataFrame:
        """artists with their tags; null where none are known or they are too old."""
        from tessitura.sources import files

        spark = artists.sparkSession
        wanted = self.keyed(artists, artist)
        if not files.exists(spark, self.path):
            return wanted.withColumn("tags", F.lit(None).cast("array<string>")).drop("key")
        known = spark.read.schema("key string, cached_at double, tags array<string>").parquet(self.path)
        latest = known.groupBy("key").agg(F.max_by("tags", "cached_at").alias("tags"), F.max("cached_at").alias("_at"))
        return wanted.join(latest.where(F.lit(float(self.clock())) - F.col("_at") <= self.ttl_s).drop("_at"), "key", "left").drop("key")


def cache_key(namespace: str, plain_name: str) -> str:
    """The key of a plain name, as TagCache makes it."""
    return hashlib.sha256(f"{namespace}:{plain_name}".encode()).hexdigest()

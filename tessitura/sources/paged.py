"""Tables behind a paged web service: a polite client with a file cache, and a Spark data source over it."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str], tuple[int, Mapping[str, str], str]]


@dataclass
class PagedClient:
    """fetch(url) -> (status, headers, body). Answers are kept by the hash of their URL for ttl_s; requests keep min_gap_s apart;
    429 and 503 are tried again after Retry-After."""

    fetch: Fetch
    cache_dir: str
    ttl_s: float = 86_400
    min_gap_s: float = 0.0
    tries: int = 4
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    _next: float = 0.0

    def get(self, url: str) -> dict:
        file = Path(self.cache_dir, hashlib.sha256(url.encode()).hexdigest() + ".json")
        if file.exists() and self.clock() - file.stat().st_mtime < self.ttl_s:
            return json.loads(file.read_text())
        for _ in range(self.tries):
            if (wait := self._next - self.clock()) > 0:
                self.sleep(wait)
            self._next = self.clock() + self.min_gap_s
            status, headers, body = self.fetch(url)
            if status == 200:
                file.parent.mkdir(parents=True, exist_ok=True)
                part = file.with_suffix(f".{os.getpid()}")
                part.write_text(body)
                part.replace(file)
                return json.loads(body)
            if status not in (429, 503):
                raise ValueError(f"{url}: status {status}")
            self.sleep(float(headers.get("Retry-After", 1)))
        raise ValueError(f"{url}: still refused after {self.tries} tries")

    def items(self, url: str, size: int, start: int = 0, end: int | None = None) -> Iterator[dict]:
        """Entries start..end of a list that is served by offset and limit."""
        at = start
        while end is None or at < end:
            n = size if end is None else min(size, end - at)
            page = self.get(f"{url}{'&' if '?' in url else '?'}offset={at}&limit={n}")["items"]
            yield from page
            if len(page) < n:
                return
            at += n


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); format("paged") with options client (module:function that makes a PagedClient), url, total, page; rows are (n, item as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "n long, item string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        total, page = int(self.options["total"]), int(self.options.get("page", 50))
        return [InputPartition((a, min(a + 10 * page, total))) for a in range(0, total, 10 * page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, make = self.options["client"].split(":")
        client = getattr(importlib.import_module(module), make)()
        start, end = partition.value
        for i, item in enumerate(client.items(self.options["url"], int(self.options.get("page", 50)), start, end)):
            yield start + i, json.dumps(item, sort_keys=True)

"""Writing tables, exports and reports."""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.sources.shapes import align


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Hive layout; rows of a partition value are brought together first, so that it gets few files, and AQE splits large ones."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def append(df: DataFrame, path: str, schema: T.StructType) -> None:
    align(df, schema).write.mode("append").parquet(path)


def write_if_changed(path: str, text: str) -> bool:
    """Whether the file was written: not, if it holds this text already."""
    file = Path(path)
    if file.exists() and file.read_text() == text:
        return False
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)
    return True


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows; write a table instead")
    return rows


def report_json(df: DataFrame, path: str, most: int = 10_000) -> bool:
    return write_if_changed(path, json.dumps([r.asDict(True) for r in _few(df, most)], indent=2, sort_keys=True, default=str) + "\n")


def report_csv(df: DataFrame, path: str, most: int = 10_000) -> bool:
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows([["" if v is None else v for v in r] for r in _few(df, most)])
    return write_if_changed(path, out.getvalue())


def report_markdown(df: DataFrame, path: str, title: str, most: int = 1_000) -> bool:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in _few(df, most))]
    return write_if_changed(path, "\n".join(lines) + "\n")


def upsert_sqlite(df: DataFrame, path: str, name: str, keys: Sequence[str], most: int = 1_000_000) -> int:
    """Rows into a SQLite table; rows with the same keys replace earlier ones. Streams partition by partition; over `most` rows raise."""
    if df.count() > most:
        raise ValueError(f"over {most} rows")
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}
    quote = lambda c: '"' + c.replace('"', '""') + '"'
    columns = ", ".join(f"{quote(c)} {kinds.get(t, 'TEXT')}" for c, t in df.dtypes)
    con = sqlite3.connect(path)
    with con:
        con.execute(f"CREATE TABLE IF NOT EXISTS {quote(name)} ({columns}, PRIMARY KEY ({', '.join(map(quote, keys))}))")
        rows = (tuple(v if isinstance(v, (int, float, str, bool, type(None))) else str(v) for v in r) for r in df.toLocalIterator())
        n = con.executemany(f"INSERT OR REPLACE INTO {quote(name)} VALUES ({', '.join('?' * len(df.columns))})", rows).rowcount
    con.close()
    return n


def ddl(name: str, schema: T.StructType, location: str, partitions: Sequence[str] = ()) -> str:
    """CREATE TABLE of an external Parquet table, and what finds its partitions."""
    body = ",\n".join(f"  `{f.name}` {f.dataType.simpleString().upper()}" for f in schema.fields if f.name not in partitions)
    parts = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in schema.fields if f.name in partitions)
    text = f"CREATE EXTERNAL TABLE IF NOT EXISTS `{name}` (\n{body}\n)" + (f"\nPARTITIONED BY ({parts})" if parts else "")
    return text + f"\nSTORED AS PARQUET\nLOCATION '{location}';\n" + (f"MSCK REPAIR TABLE `{name}`;\n" if parts else "")


def export_tables(folder: str, tables: Mapping[str, DataFrame], schemas: Mapping[str, T.StructType], partitions: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """Every table cast to its schema below folder/curated, on any file system; rows by table, counted after writing."""
    counts = {}
    for name, df in sorted(tables.items()):
        by = partitions.get(name, ())
        cast = align(df, schemas[name])
        path = f"{folder}/curated/{name}"
        write_partitioned(cast, path, by) if by else cast.write.parquet(path)
        counts[name] = df.sparkSession.read.schema(schemas[name]).parquet(path).agg(F.count(F.lit(1))).first()[0]
    return counts


def export_bundle(folder: str, tables: Mapping[str, DataFrame], schemas: Mapping[str, T.StructType], partitions: Mapping[str, Sequence[str]], raw_files: Sequence[str] = (), location: str = "s3://bucket/prefix") -> dict:
    """A fresh local folder with raw copies, every table cast to its schema, the DDL and a report, which is returned.

    A folder that is there is only replaced if it is such a bundle (it has a report) or empty.
    """
    if os.path.isdir(folder) and os.listdir(folder) and not os.path.exists(f"{folder}/report.json"):
        raise ValueError(f"{folder} holds something else")
    shutil.rmtree(folder, ignore_errors=True)
    os.makedirs(f"{folder}/raw")
    for f in raw_files:
        shutil.copy(f, f"{folder}/raw/")
    counts = export_tables(folder, tables, schemas, partitions)
    report: dict = {"raw_files": len(raw_files), "tables": counts}
    statements = [ddl(name, schemas[name], f"{location}/curated/{name}", partitions.get(name, ())) for name in counts]
    write_if_changed(f"{folder}/ddl.sql", "\n".join(statements))
    write_if_changed(f"{folder}/report.json", json.dumps(report, indent=2, sort_keys=True))
    return report

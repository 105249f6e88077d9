"""Files of runs and reports: CSV and JSON that may be missing or broken, flattened to fixed columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.sources import files
from tessitura.sources.shapes import align


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a CSV file with header, columns by name; a missing file gives none, broken lines are skipped, bad values are null."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("enforceSchema", False).csv(path)
    return align(rows, schema)


def read_document(path: str, default: object = None) -> object:
    """A JSON document, or the default if it is missing or broken."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return default


def flat(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """(path, type) of all leaves of nested structs."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += flat(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns a_b; arrays and maps as JSON text."""
    made = []
    for path, kind in flat(df.schema):
        value = F.col(path)
        made.append((F.to_json(value) if isinstance(kind, (T.ArrayType, T.MapType)) else value).alias(path.replace(".", "_")))
    return df.select(*made)


def read_manifests(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """One row per manifest file, nested objects flattened; broken files are left out."""
    return flatten(_documents(spark, pattern, schema))


def read_results(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """One row per element of result files (a list or one object each), with run_id from the folder."""
    return flatten(_documents(spark, pattern, schema)).withColumn("run_id", F.regexp_extract("source_file", "([^/]+)/[^/]+$", 1))


def _documents(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    fields = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(fields).option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(pattern)
    return rows.withColumn("source_file", F.input_file_name()).where("_broken is null").drop("_broken")


def exploded_actions(snapshots: DataFrame, actions: str) -> DataFrame:
    """One row per entry of the array of structs, with its order from 1; snapshots without entries give none."""
    return snapshots.select("*", F.posexplode(actions).alias("_i", "_a")).withColumn("action_order", F.col("_i") + 1).select(*[c for c in snapshots.columns if c != actions], "action_order", "_a.*")


def read_families(spark: SparkSession, folders: Sequence[str], file: str) -> DataFrame | None:
    """The same CSV of several folders in one table: report_family_id is the folder's name; columns that some lack are null."""
    found = None
    for folder in folders:
        path = Path(folder, file)
        if path.exists():
            part = spark.read.option("header", True).csv(str(path)).withColumn("report_family_id", F.lit(Path(folder).name))
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found

"""Small files and folders on whatever file system Hadoop knows: read, replaced in one step, listed, deleted."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    where, system = _at(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small text file; None if it isn't there."""
    where, system = _at(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """The file holds the old text or the new one, whenever a reader looks or the writer dies: written beside it, then renamed over it."""
    part, system = _at(spark, f"{path}.{uuid.uuid4().hex}")
    where, _ = _at(spark, path)
    stream = system.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    options[0] = getattr(fs, "Options$Rename").OVERWRITE
    context = fs.FileContext.getFileContext(system.makeQualified(part).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(part), system.makeQualified(where), options)

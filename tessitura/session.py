"""Sessions, and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, for tests and benches; on a cluster pass the cluster's own session."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tessitura")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a temporary one is set on a local master; a cluster raises,

    since its executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not set_dir:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="tessitura-")
        context.setCheckpointDir(set_dir)
        set_dir = context.getCheckpointDir()
    return set_dir.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again.

    Cuts the lineage, so that a lost executor costs no recomputation of what lies before, and lets several branches
    read one result. The files stay until release() of the result, forget() or the end of the driver.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._tessitura_path = path
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not there yet; what is written to it goes at the end of the driver."""
    path = f"{shared_folder(spark)}/tessitura/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(forget, spark)
    _written.add(path)
    return path


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote for this very result; nothing may read it any more."""
    path = getattr(df, "_tessitura_path", None)
    if path in _written:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)


def forget(spark: SparkSession) -> None:
    """Delete the tables that materialize() wrote for this driver."""
    try:
        for path in list(_written):
            _delete(spark, path)
    except Exception:  # the session has ended: what is left lies in the cluster's folder for checkpoints
        logging.getLogger(__name__).debug("tables in the shared folder are left", exc_info=True)


_written: set[str] = set()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers of this application the package, once, for clusters where it isn't installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessitura-")  # the driver serves the file from here while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    zipped = Path(folder, "tessitura_package.zip")
    with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(zipped))
    _shipped.add(context.applicationId)

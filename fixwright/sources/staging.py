"""Cutting a long plan at a table written to the cluster's shared folder.

A written table survives lost executors, is read back column by column, and its
row count comes from the file footers. The folder is the one the cluster names
in ``spark.checkpoint.dir``; only a local session that names none gets its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_paths: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="run-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete every table this application has written so far; for when its results have been read or stored.

    Results that still read such a table fail afterwards.
    """
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def discard(table: DataFrame) -> None:
    """Delete the folder of one written table that nothing reads any more, so that its copy does not stay for the whole job."""
    spark = table.sparkSession
    mine = _paths.get(spark.sparkContext.applicationId, [])
    named = {p for p in mine for f in table.inputFiles()[:1] if f"/{p.rstrip('/').rpartition('/')[2]}/" in f}
    for p in named:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        mine.remove(p)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and hand back the table that was written.

    With partition columns the rows are rebalanced on them first, which keeps
    files few and still splits an oversized partition over several tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

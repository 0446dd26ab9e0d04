"""The shared folder: tables written once and read several times.

Folders come from spark.checkpoint.dir, which all executors see; a written table
ends a lineage, so a lost executor costs no more than the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where that is unset on a local
    master a local folder is made and set; on a cluster that would lose files, so
    it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tarnweb-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed when the application ends."""
    path = f"{shared_dir(spark)}/tarnweb-{label}-{uuid.uuid4().hex}"
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)

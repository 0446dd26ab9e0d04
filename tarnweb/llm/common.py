"""Shared ground of the training-data operators: reading tables, the shared
folder, order-preserving shards and word splitting."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship  # noqa: F401

#: A word of the mixing and shingle operators: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch that a Python worker turns into objects at once.
SLICE = 512
Batches = Iterator[pa.RecordBatch]


def in_slices(work: Callable[[Batches], Batches], tokens: bool = False, rows: int = SLICE) -> Callable[[Batches], Batches]:
    """work for mapInArrow, over slices of at most so many rows. Workers are reused,
    so what earlier work left in the process goes first (token tables, unless
    this work uses them), and freed memory goes back to the system at the end."""

    def run(batches: Batches) -> Batches:
        table = sys.modules.get("tarnweb.llm.tokens")
        if table and not tokens:
            table.release()
        yield from work(b.slice(i, rows) for b in batches for i in range(0, len(b), rows))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session. Only
    where that is unset on a local master (tests, a laptop) a local folder is
    made and set; on a cluster that would lose files, so it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir()
    if not kept:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        kept = f"file://{tempfile.mkdtemp(prefix='tarnweb-')}"
        spark.sparkContext.setCheckpointDir(kept)
    return kept.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stash(df: DataFrame, spark: SparkSession, label: str = "stash") -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends there and a
    lost executor costs no recomputation. Returns the table and its path, which
    is removed at the end of the application if drop() has not done so."""
    path = f"{shared_dir(spark)}/tarnweb-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _path(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, fs = _path(spark, path)
        fs.delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """Up to n - 1 ascending values that cut an integer column into n shares of
    about the same number of rows. One narrow aggregation; nulls are left out."""
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(column, F.lit(shares), F.lit(max(10_000, 20 * n))).alias("b")).first()
    return sorted(set(row["b"] or []))


def shard_of(value: Column, cuts: list[int]) -> Column:
    """Number of cuts below the value, -1 for null: an order-preserving shard.
    Two levels of about sqrt(len(cuts)) comparisons each."""
    if not cuts:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = max(1, round(len(cuts) ** 0.5))
    chunks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    table = F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in c]) for c in chunks])
    tops = F.array(*[F.lit(int(c[-1])).cast("long") for c in chunks])
    upper = F.size(F.filter(tops, lambda x: x < value))
    inner = F.size(F.filter(F.element_at(table, F.least(upper + 1, F.lit(len(chunks)))), lambda x: x < value))
    return (
        F.when(value.isNull(), F.lit(-1))
        .when(upper >= len(chunks), F.lit(len(cuts)))
        .otherwise(upper * step + inner)
        .cast("int")
    )


"""Token-ID output: whole documents, encoded once, in Simple-8b files.

The text never moves: documents are encoded where they are read, and only coded
ids are dealt out by order-preserving shards of doc_id. Each shard is sorted and
written to the shared folder by Spark's own file writer (a Parquet container of
Simple-8b records, see :mod:`simple8b`), so a failed or repeated task leaves no
partial file. Positions are stored relative to the shard; a table with one row a
shard turns them into positions in the whole corpus.

Defined cases: null text counts as empty and yields just the end id; rows with
one doc_id are separate records, ordered by number of ids and content; rows with
null doc_id come first; an empty table gives no files' rows; extra columns are
not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import bounds, in_slices, partitions, read, shard_of, shared_dir, ship
from .tokens import pieces, portions

VOCABULARY, END_ID = "word_bpe_49k.json", 1


def _coder(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            records, counts = [], []
            for a, b in portions(texts):
                ids, lengths = table.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                records += simple8b.encode(ids, lengths + 1)
                counts.append(lengths + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("doc_id"), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)), pa.array(records, pa.binary())],
                names=["shard", "doc_id", "n_tokens", "ids"],
            )

    return in_slices(run, tokens=True)


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode docs(doc_id, text) and write the files in ascending doc_id order."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    shard = shard_of(F.col("doc_id"), bounds(docs, "doc_id", n))
    coded = docs.select((shard + 1).alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _coder(vocabulary, end_id), "shard int, doc_id long, n_tokens long, ids binary"
    )
    dealt = coded.repartitionById(n + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    order = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids").rowsBetween(Window.unboundedPreceding, 0)
    dealt.withColumn("at", F.sum("n_tokens").over(order) - F.col("n_tokens")).write.option("compression", "zstd").parquet(path)


def _decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = batch.column("ids").to_pylist()
        sums, counts = [], []
        for a in range(0, len(records), 256):
            ids, lengths = simple8b.decode(records[a : a + 256])
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths) * 4
            sums += [zlib.crc32(raw[e - 4 * n : e]) for n, e in zip(lengths.tolist(), ends.tolist())]
            counts.append(lengths)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("doc_id"), batch.column("at"), pa.array(n), pa.array(sums, pa.int64())],
            names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
        )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lengths = simple8b.decode(batch.column("ids").to_pylist())
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], names=["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of every record of the files."""
    return spark.read.parquet(path).select("doc_id", "ids").mapInArrow(in_slices(_ids, tokens=True), "doc_id long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files."""
    files = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        files.groupBy("shard").agg(F.max(F.col("at") + F.col("n_tokens")).alias("size"))
        .select(F.col("shard").alias("of"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    )  # a row for each shard, at most the number of shuffle partitions and one
    digests = files.mapInArrow(in_slices(_decoder, tokens=True), "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return digests.join(F.broadcast(shards), F.col("shard") == F.col("of")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder and return what they hold."""
    import uuid

    path = f"{shared_dir(spark)}/tarnweb-tokens-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    write(docs.select("doc_id", "text"), path, vocabulary, end_id)
    return read_digests(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: doc_id, start, n_tokens, ids_crc32 of all documents."""
    return encode_documents(spark, read(spark, sf_dir, "documents"))

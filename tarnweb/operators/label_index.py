"""A stored index of labels: bitmaps by label, and the records they point to.

Records are range-partitioned by their order and written once. A record's place is
(part, place): its partition and its number there, which the write itself counts,
so nothing numbers all records in one task. Sixty-four places make a word. The
words table has a row for each word and a column for each label, whose 64 bits say
which of the records carry it: a bitmap of a label is a Parquet column, and reading
a label reads nothing of the others.

A query is folded into one expression of bitwise AND, OR, XOR and NOT over such
columns, 64 records at a time, within whole-stage code. Labels that every match
must carry, rarest first, also become filters `column <> 0`, which reach the scan
and skip row groups. Only then are records read: of the parts that have a match
(partition pruning), those whose bit is set. Counts need no records at all.

Layout: path/records/part=N, path/words, path/labels (label, n), path/schema (an
empty table like the records).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.language import Token, fold, lex
from ..storage import stored
from . import labels
from .extract import ordering

WORD_BITS = 64
#: Matching words up to which they are sent to all tasks.
MAX_BROADCAST_WORDS = 1 << 20

Bits = Callable[[Column, Column], Column]
BITWISE: dict[str, Bits] = {
    "and": lambda a, b: a.bitwiseAND(b),
    "or": lambda a, b: a.bitwiseOR(b),
    "difference": lambda a, b: a.bitwiseAND(F.bitwise_not(b)),
    "neither": lambda a, b: F.bitwise_not(a.bitwiseOR(b)),
    "or_not": lambda a, b: a.bitwiseOR(F.bitwise_not(b)),
    "xor": lambda a, b: a.bitwiseXOR(b),
}


def _column(label: str) -> str:
    return f"has_{labels.PLACES[label]}"


def build(records: DataFrame, path: str, parts: int | None = None) -> None:
    """Write the index of records (with bits of both levels) to path. The records
    are best a stored table, as range partitioning reads them twice."""
    spark = records.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # In one task after the exchange: rows come in order, and the lower bits of
    # the generated id are their number within the task.
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    order = ordering("selected" in records.columns)
    dealt = records.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = dealt.select("*", F.spark_partition_id().alias("part"), local.alias("place"))
    placed = placed.select("*", F.shiftright("place", 6).alias("word"))
    placed.write.partitionBy("part").parquet(f"{path}/records")
    placed.limit(0).write.parquet(f"{path}/schema")
    rows = _records(spark, path)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(WORD_BITS - 1)).cast("int"))
    columns = [F.bit_or(F.when(labels.flag(name), bit).otherwise(F.lit(0).cast("long"))).alias(_column(name)) for name in labels.PLACES]
    words = rows.select("part", "word", "place", "bits").groupBy("part", "word").agg(F.bit_or(bit).alias("here"), *columns)
    words.repartitionByRange(n, "part", "word").sortWithinPartitions("part", "word").write.parquet(f"{path}/words")
    sums = spark.read.parquet(f"{path}/words").agg(*[F.coalesce(F.sum(F.bit_count(_column(name))), F.lit(0)).cast("long").alias(name) for name in labels.PLACES])
    sums.select(F.inline(F.array(*[F.struct(F.lit(name).alias("label"), F.col(f"`{name}`").alias("n")) for name in labels.PLACES]))).coalesce(1).write.parquet(f"{path}/labels")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The records; an index of none has their schema all the same."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/records")


class LabelIndex:
    """Queries on an index that build() has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.records = _records(spark, path)
        self.words = spark.read.parquet(f"{path}/words")
        self.counts = {r["label"]: r["n"] for r in spark.read.parquet(f"{path}/labels").collect()}  # a row a label

    def bits(self, label: str) -> Column:
        return F.col(_column(label))

    def _where(self, bits: Column, needed: set[str]) -> DataFrame:
        """part, word, hits of the words with a match. needed: labels that every
        match carries."""
        words = self.words
        for label in sorted(needed, key=lambda name: (self.counts.get(name, 0), name)):
            words = words.where(self.bits(label) != 0)
        return words.select("part", "word", bits.bitwiseAND(F.col("here")).alias("hits")).where("hits <> 0")

    def matching(self, text: str) -> DataFrame | None:
        """part, word, hits for a query text; None as run_query gives it. A query
        of one token is looked up by its raw text."""
        lexed = lex(text)
        if not lexed.valid:
            return None
        single = len(lexed.tokens) == 1
        if (single and text not in labels.PLACES) or any(t.kind == "label" and t.text not in labels.PLACES for t in lexed.tokens):
            return None
        if single:
            return self._where(self.bits(text), {text})
        bits = fold(lexed.tokens, self.bits, F.bitwise_not, BITWISE["and"], BITWISE["or"])
        return self._where(bits, needed_labels(lexed.tokens))

    def fetch(self, matches: DataFrame) -> DataFrame:
        """The records of matching words, read from parts that have any."""
        found = stored(matches, "matches")
        hits = F.broadcast(found) if found.count() <= MAX_BROADCAST_WORDS else found
        at = F.col("place").bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
        rows = self.records.join(hits, ["part", "word"]).where(F.call_function("getbit", F.col("hits"), at) == 1)
        return rows.drop("hits", "part", "place", "word")

    def query(self, text: str) -> DataFrame | None:
        """Records that match, as run_query gives them."""
        matches = self.matching(text)
        return None if matches is None else self.fetch(matches)

    def combine(self, a: str, b: str, how: str | Bits) -> DataFrame:
        """Records by an operation on two labels, named or given on bits."""
        f = BITWISE[how] if isinstance(how, str) else how
        needed = {"and": {a, b}, "difference": {a}}.get(how, set()) if isinstance(how, str) else set()
        return self.fetch(self._where(f(self.bits(a), self.bits(b)), needed))

    def complement(self, a: str) -> DataFrame:
        return self.fetch(self._where(F.bitwise_not(self.bits(a)), set()))

    def parity(self, names: list[str]) -> DataFrame:
        """Records with an odd number of the labels."""
        return self.fetch(self._where(reduce(BITWISE["xor"], map(self.bits, names)), set()))


def n_matching(matches: DataFrame) -> Column:
    """Number of records in matching words, as an aggregate."""
    return F.coalesce(F.sum(F.bit_count("hits")), F.lit(0)).cast("long")


def needed_labels(tokens: list[Token]) -> set[str]:
    """Labels that every match of a query carries."""
    # Each part of a query is a pair: labels that all matches carry, labels that
    # all other records carry (which is what a negation needs).
    yes, _ = fold(tokens, lambda name: ({name}, set()), lambda a: (a[1], a[0]), lambda a, b: (a[0] | b[0], a[1] & b[1]), lambda a, b: (a[0] & b[0], a[1] | b[1]))
    return yes

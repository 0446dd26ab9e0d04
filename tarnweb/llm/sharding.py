"""Documents into shards of near equal bytes, copies together.

Law `bytes`. A group is all rows of one text and is never cut. Groups stand in
the order of a 64-bit hash of their text, and shards are stretches of that order:
the minimax contiguous partition. Its capacity, the least that lets all groups fit
in order, is found by binary search with a greedy check.

The groups themselves never leave the executors. The check runs on sums of blocks,
which are ranges of the hash, at most LEVEL of them a round. Cuts at ends of blocks
give a capacity that is feasible; cuts allowed anywhere inside a block give one
below which none is. While the two differ, the ranges where a cut may lie are
summed again in finer blocks, until blocks there are single groups or the two
agree. Each round is one small aggregation of a narrow table with a pushed-down
range filter; the number of rounds grows with the logarithm of the table.

A group larger than an even share of what is left would leave other shards short
in any contiguous partition. Such groups (fewer than shards) come first in the
order, each as a shard of its own, and the rest is cut as above.

Slots: rows of one id and text are counted first, so repeated rows travel as one
row and are written out in chunks; chunks are dealt to parts by hash, numbered
within the part, and a table of sums (a row a part) gives each part its base. No
task holds a shard or a group.

Defined cases: a null text has no bytes (size 8) and null texts are one group,
apart from empty ones; rows that share a doc_id are separate rows, equal rows get
different slots; null doc_ids are numbered like others; an empty table gives an
empty result; fewer groups than shards leave shards empty; two texts of one hash
(none expected below billions) stay together, which no law forbids; extra columns
are ignored by the query and kept by `write`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, partitions, read, stash

SHARDS = 24
#: Blocks of the first round, in bits, and of any later round at most.
FIRST_BITS, LEVEL = 12, 1 << 15
#: Copies of one row in a chunk; chunks in a part, about.
CHUNK, PART = 4096, 1 << 18


def group_key(text: Column) -> Column:
    return F.xxhash64(text)


def size_of(text: Column) -> Column:
    """Bytes of the text and 8 for its place in an index."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


@dataclass(frozen=True)
class Block:
    """Sum of the groups whose keys agree in their first bits; low and high are
    the least and the greatest key there."""

    size: int
    low: int
    high: int
    bits: int

    @property
    def single(self) -> bool:
        return self.low == self.high


def _sums(groups: DataFrame, bits: int, ranges: list[tuple[int, int]] | None = None) -> list[Block]:
    """Blocks of 64 - bits low bits of the key, in order, within key ranges."""
    if ranges is not None:
        inside = F.lit(False)
        for a, b in ranges:
            inside = inside | F.col("key").between(F.lit(a), F.lit(b))
        groups = groups.where(inside)
    block = F.shiftright("key", 64 - bits) if bits < 64 else F.col("key")
    rows = groups.groupBy(block.alias("block")).agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    return sorted((Block(r["size"], r["low"], r["high"], bits) for r in rows), key=lambda b: b.low)


def _finer(groups: DataFrame, blocks: list[Block], doubtful: list[bool]) -> list[Block]:
    """Blocks with the coarsest of the doubtful ones cut up, to LEVEL in all."""
    coarse = min(b.bits for b, d in zip(blocks, doubtful) if d)
    wanted = [d and b.bits == coarse for b, d in zip(blocks, doubtful)]
    ranges: list[tuple[int, int]] = []
    for i, b in enumerate(blocks):
        if wanted[i] and i and wanted[i - 1]:
            ranges[-1] = (ranges[-1][0], b.high)
        elif wanted[i]:
            ranges.append((b.low, b.high))
    width, bits = sum(b - a + 1 for a, b in ranges), 64
    while bits > coarse + 1 and (width >> (64 - bits)) + 2 * len(ranges) > LEVEL:
        bits -= 1
    old = [b for b, w in zip(blocks, wanted) if not w]
    return sorted(old + _sums(groups, bits, ranges), key=lambda b: b.low)


def _reach(ends: list[int], blocks: list[Block], capacity: int, shards: int, inside: bool) -> list[int]:
    """Greedy cuts: how far each shard comes with a capacity. inside: cuts may
    lie anywhere in a block of several groups, else only at ends of blocks."""
    cuts, at = [], 0
    for _ in range(shards):
        far = at + capacity
        i = bisect_right(ends, far)  # blocks that end by then
        at = far if inside and i < len(blocks) and not blocks[i].single else max(at, ends[i - 1] if i else 0)
        cuts.append(min(at, ends[-1]))
    return cuts


def _least(ends: list[int], blocks: list[Block], shards: int, inside: bool) -> int:
    """The least capacity with which all blocks fit, by binary search."""
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if _reach(ends, blocks, middle, shards, inside)[-1] >= ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


@dataclass(frozen=True)
class Plan:
    """alone: keys of groups with a shard of their own, in order of shards; last:
    the last key of each shard after those but the final one; capacity: of these."""

    alone: tuple[int, ...]
    last: tuple[int, ...]
    capacity: int

    def shard(self, key: Column) -> Column:
        """Number of a key's shard."""
        rest = F.lit(len(self.alone)) + sum((F.when(key > F.lit(k), 1).otherwise(0) for k in self.last), F.lit(0))
        for i, k in reversed(list(enumerate(self.alone))):
            rest = F.when(key == F.lit(k), i).otherwise(rest)
        return rest.cast("int")


def plan(groups: DataFrame, shards: int = SHARDS) -> Plan:
    """Cuts of groups(key, size); a key may have several rows. It is read once a
    round, so it should be a stored table."""
    blocks, alone = _sums(groups, FIRST_BITS), []
    others = lambda: groups.where(~F.col("key").isin(alone)) if alone else groups
    while blocks and len(alone) < shards - 1:  # groups above an even share of the rest
        share = sum(b.size for b in blocks) / (shards - len(alone))
        large = [b for b in blocks if b.size > share]
        if not all(b.single for b in large):
            blocks = _finer(others(), blocks, [b.size > share and not b.single for b in blocks])
        elif large:
            alone.append(max(large, key=lambda b: (b.size, -b.low)).low)
            blocks = [b for b in blocks if not (b.single and b.low == alone[-1])]
        else:
            break
    left = shards - len(alone)
    while blocks:
        ends = list(accumulate(b.size for b in blocks))
        capacity, bound = (_least(ends, blocks, left, inside) for inside in (False, True))
        doubtful = [False] * len(blocks)
        if bound < capacity:  # each cut lies between these two
            for a, b in zip(_reach(ends, blocks, bound, left, False), _reach(ends, blocks, capacity, left, True)):
                for i in range(bisect_right(ends, a), min(bisect_left(ends, b) + 1, len(blocks))):
                    doubtful[i] = not blocks[i].single
        if any(doubtful):
            blocks = _finer(others(), blocks, doubtful)
            continue
        cuts = _reach(ends, blocks, capacity, left, False)
        return Plan(tuple(alone), tuple(blocks[bisect_left(ends, c)].high for c in cuts[:-1] if 0 < c < ends[-1]), capacity)
    return Plan(tuple(alone), (), 0)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, key, size, text_crc32, shard, slot of every row of docs(doc_id,
    text). Texts are read once; the rest works on a narrow stored table."""
    spark = docs.sparkSession
    text = F.col("text")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(text).alias("key"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    rows, _ = stash(narrow, spark, "sizes")
    found = plan(rows.select("key", "size"), shards)
    counted = rows.groupBy("doc_id", "key", "size", "text_crc32").agg(F.count("*").alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    chunks = counted.select("*", chunk.alias("chunk")).withColumn("n", F.least(F.col("n") - F.col("chunk") * CHUNK, F.lit(CHUNK)))
    parts = max(1, partitions(spark) // shards, rows.count() // (shards * PART))
    part = F.pmod(F.xxhash64("doc_id", "key", "chunk"), F.lit(parts)).cast("int")
    placed, _ = stash(chunks.select("doc_id", "key", "size", "text_crc32", "n", "chunk", found.shard(F.col("key")).alias("shard"), part.alias("part")), spark, "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "part").agg(F.sum("n").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "key", "text_crc32", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0))).join(bases, ["shard", "part"])
    slot = F.explode(F.sequence(F.col("base") + F.col("first"), F.col("base") + F.col("first") + F.col("n") - 1))
    return numbered.select("doc_id", "key", "size", "text_crc32", "shard", slot.alias("slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> Plan:
    """Write docs as Parquet folders shard=0, shard=1, ..., copies together. Each
    shard is dealt to several files, so no task writes a whole one."""
    spark = docs.sparkSession
    sizes, at = stash(docs.select(group_key(F.col("text")).alias("key"), size_of(F.col("text")).alias("size")), spark, "sizes")
    found = plan(sizes, shards)
    drop(spark, at)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    dealt = docs.select(*kept, found.shard(group_key(F.col("text"))).alias("shard"))
    files = max(1, partitions(spark) // shards)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"]), F.lit(files))
    dealt.repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: shard and slot of all documents by the law `bytes`."""
    out = assign(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

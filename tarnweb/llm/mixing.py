"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in a reproducible shuffle. Its virtual
finish time is the running number of words of its source up to and including
it, divided by the source's weight; a further pass over the source goes on from
where the one before ended. All copies are range-sorted by finish time and the
sequence is cut at the total budget. Sources that run out of passes fall out of
the queue, and what they leave goes to the others by weight, which is just what
the targets say.

Within a source and pass finish times follow the order of the shuffle, so all that
the documents need to know is the last place taken in each pass of their source:
only (source, place, size) is shuffled and sorted, never a text. Copies of one row
share a place; where the cut goes through them, they are numbered.

Nothing is gathered by source: running sums are taken in (source, slice of the
shuffle) groups, whose totals are added up in a table of sources x slices, so a
source with a third of all rows is spread as evenly as any other.

Defined cases: null text or text without words has size 0 and is taken as often
as its finish time allows, adding nothing; a null source is a source of its
own, last in order; rows with one doc_id are separate documents (equal rows are
interchangeable); an empty table gives an empty result; extra columns are kept
and may have any name, as the row travels as one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, drop, partitions, read, stash

WEIGHTS, SHARE, PASSES, SEED = (3, 1, 2), 1.5, 2, "tarn"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """60 uniform bits of the id's MD5, as other engines compute them too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, passes: int) -> DataFrame:
    """Per source: src, sid, weight, source_size, target. sizes: src, size.

    With sources in the order of limit / weight, the k-th is held at its limit
    if the water level, (budget - limits before it) / (weights from it on),
    reaches limit / weight; the level at the first that isn't held serves the
    rest. Windows run over one row a source."""
    totals = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        totals.withColumn("sid", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1))
        .withColumn("limit", F.col("source_size") * passes)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn(
            "level",
            (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
            / F.sum("weight").over(onward),
        )
        .withColumn("first_free", F.min(F.when(F.col("ratio") > F.col("level"), F.col("place"))).over(everything))
        .withColumn("water", F.max(F.when(F.col("place") == F.col("first_free"), F.col("level"))).over(everything))
        .select(
            "src",
            "sid",
            "weight",
            "source_size",
            F.when(F.col("first_free").isNull() | (F.col("place") < F.col("first_free")), F.col("limit").cast("double"))
            .otherwise(F.col("weight") * F.col("water"))
            .alias("target"),
        )
    )


def _of_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the figures of their source."""
    return rows.join(sources, rows["src"].eqNullSafe(sources["src"])).drop("src")


def _queued(rows: DataFrame, sources: DataFrame, slices: DataFrame, bits: int) -> DataFrame:
    """Adds each row's source figures and its running words within the source."""
    order = Window.partitionBy("sid", "slice").orderBy("key", "tie", "size")
    return (
        _of_source(rows, sources)
        .withColumn("slice", F.shiftright("key", 60 - bits))
        .join(slices, ["sid", "slice"])
        .withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )


def _finish(passed: Column | int) -> Column:
    return (F.col("source_size") * passed + F.col("upto")) / F.col("weight")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    seed: str = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """row (struct of docs' columns), size, source_size, target, copies: how
    often the mix takes each document, between 0 and passes. Tables of a row for
    each source are broadcast up to MAX_SOURCES rows and joined by key beyond."""
    spark: SparkSession = docs.sparkSession
    size = word_count(F.col(text)) if size is None else size
    bits = max(4, (4 * partitions(spark)).bit_length())
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("src"),
        size.alias("size"),
        shuffle_key(F.col(doc_id), seed).alias("key"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("tie"),
    )
    narrow, at_narrow = stash(rows.drop("row"), spark, "mix-sizes")
    sources, at_sources = stash(targets(narrow.select("src", "size"), weights, share, passes).coalesce(1), spark, "mix-sources")
    few = sources.count() <= MAX_SOURCES
    sources = F.broadcast(sources) if few else sources
    by_slice = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        _of_source(narrow, sources)
        .groupBy("sid", F.shiftright("key", 60 - bits).alias("slice"))
        .agg(F.sum("size").alias("words"))
        .select("sid", "slice", F.coalesce(F.sum("words").over(by_slice), F.lit(0)).alias("before"))
    )
    slices, at_slices = stash(slices, spark, "mix-slices")
    queue = (
        _queued(narrow, sources, slices, bits)
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .select("sid", "pass", _finish(F.col("pass")).alias("finish"), "key", "tie", "size")
    )
    # The global range sort, kept in the shared folder: a file of it is one range.
    order = ["finish", "key", "tie", "size"]
    ranged = queue.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged, at_ranged = stash(ranged.withColumn("range", F.spark_partition_id()), spark, "mix-queue")
    parts = sorted((r["range"], r["words"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("words")).collect())
    budget = int(sum(words for _, words in parts) // passes * share)
    cut, done = None, 0
    for part, words in parts:  # one row a range
        if done + words > budget:
            inside = ranged.where(F.col("range") == part).withColumn(
                "run", F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
            )
            last = inside.where(F.col("run") + done <= budget).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
            first = ranged.where(F.col("range") == part).agg(F.min(F.struct(*order)).alias("first")).first()["first"]
            cut, strict = (last, False) if last else (first, True)
            break
        done += words
    taken = F.lit(True)
    if cut is not None:
        limit = F.struct(F.lit(cut[0]), F.lit(cut[1]).cast("long"), F.lit(cut[2]).cast("long"), F.lit(cut[3]).cast("long"))
        taken = F.struct(*order) < limit if strict else F.struct(*order) <= limit
    place = F.struct("key", "tie", "size")
    # At each place: rows, and how many of them the pass takes. Then the last place with any.
    places = ranged.groupBy("sid", "pass", place.alias("place")).agg(F.count("*").alias("rows"), F.count_if(taken).alias("taken")).where("taken > 0")
    lasts = places.groupBy("sid", "pass").agg(F.max(F.struct("place", "taken", "rows")).alias("last"))
    lasts, at_lasts = stash(lasts.groupBy("sid").agg(F.collect_list("last").alias("lasts")), spark, "mix-lasts")  # a row a pass
    split = lasts.where(F.exists("lasts", lambda x: x["taken"] < x["rows"])).limit(1).count() > 0
    drop(spark, at_ranged, at_narrow, at_slices)
    placed = _of_source(rows, sources).withColumn("place", place).join(F.broadcast(lasts) if few else lasts, "sid", "left")

    def count(matches) -> Column:
        return F.coalesce(F.size(F.filter("lasts", matches)), F.lit(0))

    def through(x: Column) -> Column:
        return (x["place"] == F.col("place")) & (x["taken"] < x["rows"])

    plain = count(lambda x: (F.col("place") < x["place"]) | ((F.col("place") == x["place"]) & (x["taken"] >= x["rows"])))
    out = ["row", "size", "source_size", "target"]
    if not split:
        return placed.select(*out, plain.alias("copies"))
    cut_through = F.coalesce(F.exists("lasts", through), F.lit(False))
    numbered = placed.where(cut_through).withColumn("number", F.row_number().over(Window.partitionBy("sid", "place").orderBy("sid")))
    some = numbered.select(*out, (plain + count(lambda x: through(x) & (F.col("number") <= x["taken"]))).alias("copies"))
    return placed.where(~cut_through).select(*out, plain.alias("copies")).unionByName(some)


#: Sources are data sets, not documents; their table is broadcast up to here.
MAX_SOURCES = 100_000


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    taken = mix(docs, **options)
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, size, source_size, target, taken for all documents."""
    docs = read(spark, sf_dir, "documents")
    taken = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), size=F.col("words"))
    return taken.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('tarn:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key,
         coalesce(doc_id, -9223372036854775808) AS tie FROM documents),
s0 AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src NULLS LAST) AS sid FROM d GROUP BY src),
s1 AS (SELECT *, [3.0, 1.0, 2.0][((sid - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2 AS lim FROM s0),
s2 AS (SELECT *, lim::DOUBLE / weight AS ratio FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY ratio, sid) AS place,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(lim) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
s4 AS (SELECT *, min(CASE WHEN ratio > lvl THEN place END) OVER () AS free FROM s3),
s5 AS (SELECT *, max(CASE WHEN place = free THEN lvl END) OVER () AS water FROM s4),
s AS (SELECT src, sid, weight, source_size,
        CASE WHEN free IS NULL OR place < free THEN lim::DOUBLE ELSE weight * water END AS target FROM s5),
q AS (SELECT d.*, s.source_size, s.target, s.weight,
        sum(d.size) OVER (PARTITION BY sid ORDER BY key, tie, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN s ON d.src IS NOT DISTINCT FROM s.src),
c AS (SELECT doc_id, size, source_size, target, key, tie, p, (source_size * p + upto)::DOUBLE / weight AS finish
      FROM q, (VALUES (0), (1)) AS x(p)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, key, tie, size ROWS UNBOUNDED PRECEDING) AS run,
        floor((sum(size) OVER ())::DOUBLE / 2 * 1.5) AS budget FROM c)
SELECT doc_id, size, source_size, target, sum(CASE WHEN run <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM r GROUP BY doc_id, tie, size, source_size, target
"""

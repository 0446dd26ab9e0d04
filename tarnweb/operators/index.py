"""Result indexes: page -> elements and element -> pages.

Duplicates stay and values keep record order, so lists are collected with the
record key and sorted. `index` gives a row a key, `pieces` rows of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.language import is_simple
from ..storage import stored
from .extract import display, record_key

#: Values in a row of `pieces`.
PIECE = 10_000


def _instance(query: str) -> Column:
    """What an element is called in its page."""
    if is_simple(query):
        return display(F.col("markup")) if query == "userSelected" else F.col("url_attr")
    return F.coalesce("url_attr", display(F.col("markup")))


def _location(query: str) -> Column:
    """What an element is called as a key. A bare label other than `anchor`
    drops the fragment."""
    prop = F.when(F.col("url_prop") != "", F.col("url_prop"))
    if is_simple(query):
        if query == "userSelected":
            return display(F.col("markup"))
        return F.col("url_prop") if query == "anchor" else urls.without_fragment(F.col("url_prop"))
    return F.coalesce(prop, display(F.col("markup")))


def _rows(matching: DataFrame, query: str, inverted: bool) -> DataFrame:
    """key, at (record key), value of each record."""
    element = _location(query) if inverted else _instance(query)
    key, value = (element, F.col("document")) if inverted else (F.col("document"), element)
    return matching.select(key.alias("key"), record_key("selected" in matching.columns).alias("at"), value.alias("value"))


def index(matching: DataFrame, query: str, inverted: bool = False) -> DataFrame:
    """key, values (in record order), first_record: a key is one row, so all its
    values meet in one task. Where keys may be hot, use pieces."""
    rows = _rows(matching, query, inverted).select("key", F.struct("at", "value").alias("item"))
    return rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["value"]).alias("values"), F.min("item.at").alias("first_record"))


def pieces(matching: DataFrame, query: str, inverted: bool = False, size: int = PIECE) -> DataFrame:
    """key, piece (from 0), values, first_record: the index with the values of a
    key in rows of at most `size`, in record order; joined in the order of pieces
    they are the values of `index`.

    Rows are range-partitioned by key and record, so a hot key is dealt to many
    tasks, and written once with their number in the task. A table of counts (a row
    for each key and partition that holds some of it) gives the number of values
    of the key before the partition's; from it and its place a row knows its piece."""
    spark = matching.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(_rows(matching, query, inverted), "rows")
    dealt = rows.repartitionByRange(n, "key", "at").sortWithinPartitions("key", "at")
    placed = stored(dealt.select("key", "at", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "placed")
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("key").alias("of"), F.col("part").alias("in"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = placed.join(bases, F.col("key").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    number = F.floor((F.col("base") + F.col("place") - F.col("first")) / size)
    item = F.struct("at", "value")
    grouped = joined.groupBy("key", number.alias("piece")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select("key", "piece", F.transform("items", lambda x: x["value"]).alias("values"), F.col("items")[0]["at"].alias("first_record"))

"""Set algebra on label flags, n-ary predicates and URL membership."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.language import fold, lex
from .labels import flag

OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "difference": lambda a, b: a & ~b,
    "neither": lambda a, b: ~(a | b),
    "or_not": lambda a, b: a | ~b,
    "xor": lambda a, b: a != b,
}


def complement(df: DataFrame, a: str) -> DataFrame:
    return df.where(~flag(a))


def combine(df: DataFrame, a: str, b: str, how: str | Callable[[Column, Column], Column]) -> DataFrame:
    """Records by an operation on two labels, named or given."""
    f = OPERATIONS[how] if isinstance(how, str) else how
    return df.where(f(flag(a), flag(b)))


def where_all(df: DataFrame, labels: list[str], predicate: Callable[[list[Column]], Column]) -> DataFrame:
    """Records by a predicate over any number of labels."""
    return df.where(predicate([flag(n) for n in labels]))


def parity(df: DataFrame, labels: list[str]) -> DataFrame:
    """Records with an odd number of the labels."""
    return where_all(df, labels, lambda flags: reduce(lambda a, b: a != b, flags))


def by_sets(df: DataFrame, query: str, key: str = "record_id") -> DataFrame:
    """Keys of a query's records by intersect, union and except: another plan
    for the same answer, used to check the compiled filter."""
    universe = df.select(key).distinct()
    leaf = lambda name: df.where(flag(name)).select(key).distinct()
    return fold(lex(query).tokens, leaf, lambda a: universe.subtract(a), lambda a, b: a.intersect(b), lambda a, b: a.union(b).distinct())


def lookup(urls: DataFrame, elements: DataFrame) -> DataFrame:
    """url, found ('Found' or 'None') by equality with an href or src attribute
    of a link or image."""
    known = elements.where(F.col("kind").isin("link", "image")).select(F.col("url_attr").alias("url")).where("url is not null").distinct().withColumn("_hit", F.lit(True))
    return urls.select("url").join(known, "url", "left").select("url", F.when(F.col("_hit"), "Found").otherwise("None").alias("found"))

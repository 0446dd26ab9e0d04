"""Suggestions of labels for a pattern, best first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import insertions
from .labels import PLACES, flag


def suggest(candidates: DataFrame, pattern: str, limit: int | None = None, case_sensitive: bool = False) -> DataFrame:
    """suggestion, ordinal, insertions: matches by fewest insertions, ties in
    the given order. If nothing matches, all candidates in that order.

    candidates: suggestion, ordinal."""
    scored = candidates.select("suggestion", "ordinal", insertions(F.lit(pattern), F.col("suggestion"), case_sensitive).alias("insertions"))
    hit = scored.where("insertions >= 0")
    found = scored if hit.isEmpty() else hit
    ordered = found.orderBy(*([] if found is scored else ["insertions"]), "ordinal")
    return ordered.limit(limit) if limit is not None else ordered


def label_counts(records: DataFrame) -> DataFrame:
    """label, n, is_empty for every label: one pass, one row a label."""
    sums = records.agg(*[F.count_if(flag(n)).alias(n) for n in PLACES])
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"`{n}`").alias("n")) for n in PLACES])
    return sums.select(F.inline(pairs)).withColumn("is_empty", F.col("n") == 0)

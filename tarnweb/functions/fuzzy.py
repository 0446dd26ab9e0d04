"""In-order subsequence matching and its score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_PATTERN, PATTERN_TOO_LONG, NO_MATCH = -1, -2, -3


@dataclass(frozen=True)
class Match:
    ok: bool
    error: int | None = None
    insertions: int | None = None
    tokens: tuple[tuple[str, bool], ...] = ()


def _folded(text: Column, case_sensitive: bool) -> Column:
    """Accents never count; case counts if asked for."""
    return F.collate(text, "UNICODE_AI" if case_sensitive else "UNICODE_CI_AI")


def insertions(pattern: Column, ref: Column, case_sensitive: bool = False) -> Column:
    """Characters of ref beyond the pattern, or an error code. Each character of
    the pattern is looked for after the place of the one before."""
    after = F.aggregate(
        F.split(pattern, ""),
        F.lit(1),
        lambda at, c: F.when((at == 0) | (c == ""), at).otherwise(_next_place(ref, c, at, case_sensitive)),
    )
    return (
        F.when(F.length(pattern) == 0, EMPTY_PATTERN)
        .when(F.length(pattern) > F.length(ref), PATTERN_TOO_LONG)
        .when(after == 0, NO_MATCH)
        .otherwise(F.length(ref) - F.length(pattern))
    )


def _next_place(ref: Column, c: Column, at: Column, case_sensitive: bool) -> Column:
    """Place after the first c at or after `at`, 0 if there is none."""
    found = F.array_position(
        F.transform(F.split(F.substr(ref, at, F.length(ref)), ""), lambda x: _folded(x, case_sensitive) == _folded(c, case_sensitive)), F.lit(True)
    )
    return F.when(found == 0, F.lit(0)).otherwise(at + found.cast("int"))


def fuzzy_match(pattern: str, ref: str, case_sensitive: bool = False) -> Match:
    """Driver-side form with the alternating tokens, for one pair."""
    import unicodedata

    def fold(c: str) -> str:
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        return bare if case_sensitive else bare.casefold()

    if not pattern:
        return Match(False, EMPTY_PATTERN)
    if len(pattern) > len(ref):
        return Match(False, PATTERN_TOO_LONG)
    marks, wanted = [], 0
    for c in ref:
        hit = wanted < len(pattern) and fold(c) == fold(pattern[wanted])
        wanted += hit
        marks.append(hit)
    if wanted < len(pattern):
        return Match(False, NO_MATCH)
    tokens: list[list] = []
    for c, hit in zip(ref, marks):
        if tokens and tokens[-1][1] == hit:
            tokens[-1][0] += c
        else:
            tokens.append([c, hit])
    return Match(True, None, marks.count(False), tuple((s, m) for s, m in tokens))

"""String functions: truncation of markup and of previews, label in a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKUP_CHARS, PREVIEW_CHARS = 80, 5000


def truncated_markup(html: Column, limit: int = MARKUP_CHARS) -> Column:
    return F.when(F.length(html) > limit, F.concat(F.substring(html, 1, limit), F.lit("..."))).otherwise(html)


def cut_off(text: str, limit: int, at: str) -> str:
    """The text up to its last `at` that starts no later than `limit`; all of it
    if it is shorter, nothing if there is no such place."""
    if limit > len(text):
        return text
    place = text.rfind(at, 0, limit + len(at))
    return text[:place] if place > 0 else ""


def preview(text: str, limit: int = PREVIEW_CHARS) -> str:
    return text if len(text) <= limit else cut_off(text, limit, "\n") + "\n..."


def cut_off_column(text: Column, limit: int, at: str) -> Column:
    """cut_off as a Column, for a one-character `at`."""
    head = F.substring(text, 1, limit + 1)
    place = F.length(head) - F.locate(at, F.reverse(head)) if len(at) == 1 else F.lit(None)
    return F.when(F.length(text) < limit, text).when(head.contains(at), F.substr(head, F.lit(1), place)).otherwise("")

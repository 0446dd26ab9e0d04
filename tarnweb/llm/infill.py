"""Fill-in-the-middle: a text's middle moves to its end, between marks.

A text is cut into units (runs of letters, and other characters one by one). Two
seeds of the document pick where prefix and middle end, a third whether the text
is transformed at all, a fourth the order of the parts. The work is row by row in
Arrow-batched pandas UDFs: nothing is shuffled, and a text is held once with an
array of four bytes a unit.

Forms: `plain` (the text as it is: empty texts, texts that hold a mark, and the
share of others that stays as it is), `psm` (prefix, suffix, middle) and `spm`
(suffix, prefix, middle). No part holds a mark and no mark overlaps itself, so the
first place of each mark in turn is the one that was put there, and `restored`
gives the exact text back.

Defined cases: a null text counts as empty (plain, n = 0); a null doc_id has the
seeds of `1:null`; rows that share a doc_id have the same seeds and are cut by
their own text; an empty table gives an empty result; extra columns are kept by
`transformed` (its own columns replace those of the same name) and ignored by the
query.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructType

from .common import read, ship

#: Marks, units, shares (in hundredths) and the seeds' first part.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[A-Za-z]+|[^A-Za-z]"
TRANSFORMED, SPM, SEED = 90, 20, "1:"
MADE = StructType().add("n", LongType()).add("form", StringType()).add("prefix_chars", LongType()).add("middle_chars", LongType()).add("output", StringType()).add("output_sha256", StringType())


def seeds(doc_id: int | None, first: str = SEED) -> tuple[int, ...]:
    """Four numbers of 32 bits that depend on the document's id alone."""
    digest = hashlib.sha256(f"{first}{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def unit_ends(text: str) -> array:
    """Where each unit ends, four bytes a unit."""
    import regex

    return array("I", (m.end() for m in regex.finditer(UNIT, text)))


def infill(text: str, drawn: tuple[int, ...]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = drawn
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    lower, upper = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (lower, upper))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def rebuilt(output: str, form: str) -> str:
    """The text an output was made of."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"not an output of form {form}")
    one, _, rest = output[len(first) :].partition(second)
    two, mark, middle = rest.partition(MIDDLE)
    if not mark:
        raise ValueError(f"not an output of form {form}")
    return two + middle + one if form == "spm" else one + middle + two


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pandas_udf(MADE)
def made(doc_id: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Ids come as text, as pandas turns numbers with nulls into floats."""
    rows = [infill(t or "", seeds(d)) for d, t in zip(doc_id, text)]
    out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
    out["output_sha256"] = [_sha256(r[4]) for r in rows]
    return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


@pandas_udf(StringType())
def restored(output: pd.Series, form: pd.Series) -> pd.Series:
    """The exact texts of outputs."""
    return pd.Series([rebuilt(o, f) for o, f in zip(output, form)], dtype=object)


def transformed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars, output and output_sha256."""
    ship(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MADE.names]
    step = docs.select(*kept, made(F.col(doc_id).cast("long").cast("string"), F.col(text)).alias("_made"))
    return step.select("*", "_made.*").drop("_made")


def restored_sha256(output: Column, form: Column) -> Column:
    return F.sha2(restored(output, form), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: form, cuts and digests of all documents, texts rebuilt from outputs."""
    out = transformed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored_sha256(F.col("output"), F.col("form")).alias("restored_sha256"))

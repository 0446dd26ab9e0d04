"""JSON output of an index, its preview, its file name and facts of the run.

`pretty` makes the indented text on the driver, for small reports. `write_pretty`
has executors write the same text, and `previewed` reads no more of it than is
shown; both take the pieces of an index, so no row grows with a key.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PREVIEW_CHARS, preview
from ..storage import stored

#: Keys that stand first, in numeric order.
NUMERIC = r"^(?:0|[1-9][0-9]{0,9})$"
MAX_NUMERIC = 2**32 - 1


def write_json(index: DataFrame, path: str) -> None:
    """JSON lines, one key each, written by the executors."""
    index.select("key", "values").write.json(path)


def pretty(index: DataFrame, max_keys: int | None = None) -> str:
    """The index as indented JSON in key order; for reports, on the driver.
    Integer-like keys come first, in numeric order."""
    rows = index.orderBy("first_record")
    rows = rows.limit(max_keys) if max_keys is not None else rows
    entries = [(r["key"], list(r["values"])) for r in rows.toLocalIterator()]
    numeric = [e for e in entries if e[0] and re.fullmatch(r"0|[1-9][0-9]{0,9}", e[0]) and int(e[0]) < 2**32 - 1]
    rest = [e for e in entries if e not in numeric]
    ordered = sorted(numeric, key=lambda e: int(e[0])) + rest
    return json.dumps({"null" if k is None else k: v for k, v in ordered}, indent=2, ensure_ascii=False)


def shown(index: DataFrame) -> str:
    return preview(pretty(index))


def _quoted(value: Column) -> Column:
    """JSON text of a string; control characters are spelled in lower case."""
    text = F.to_json(F.array(value))
    text = F.substr(text, F.lit(2), F.length(text) - 2)
    upper = [f"{c:04X}" for c in range(32) if re.search("[A-F]", f"{c:04X}")]
    odd = reduce(lambda t, u: F.regexp_replace(t, rf"(?<!\\)((?:\\\\)*)\\u{u}", rf"$1\\u{u.lower()}"), upper, text)
    return F.when(text.rlike(r"\\u00[01][A-F]"), odd).otherwise(text)


def fragments(pieces: DataFrame) -> DataFrame:
    """section, number, first, piece, text: the lines of the indented JSON of an
    index in pieces (key, piece, values, first_record). Sorted by the first four
    columns and set one under another they are the text."""
    numeric = F.col("key").rlike(NUMERIC) & (F.col("key").cast("long") < MAX_NUMERIC)
    per = pieces.groupBy("key").agg(F.max("piece").alias("last_piece"), F.min("first_record").alias("first"))
    of = per.withColumnRenamed("key", "of")
    rows = pieces.join(of, F.col("key").eqNullSafe(F.col("of"))).select(
        F.when(numeric, 1).otherwise(2).alias("section"), F.when(numeric, F.col("key").cast("long")).otherwise(0).alias("number"), "first", "piece", "last_piece", "key", "values"
    )
    rows = stored(rows, "fragments")
    final = rows.agg(F.max(F.struct("section", "number", "first")).alias("at")).first()["at"]
    head = F.when(F.col("piece") == 0, F.concat(F.lit("  "), _quoted(F.coalesce("key", F.lit("null"))), F.lit(": [\n"))).otherwise("")
    lines = F.array_join(F.transform("values", lambda v: F.concat(F.lit("    "), F.when(v.isNull(), F.lit("null")).otherwise(_quoted(v)))), ",\n")
    if final is None:
        return rows.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("number"), F.lit(None).alias("first"), F.lit(0).cast("long").alias("piece"), F.lit("{}").alias("text"))
    whole = F.struct("section", "number", "first")
    close = F.when(F.col("piece") < F.col("last_piece"), ",").otherwise(F.concat(F.lit("\n  ]"), F.when(whole == _literal(final, rows.select(whole.alias("s")).schema["s"].dataType), "").otherwise(",")))
    body = rows.select("section", "number", "first", "piece", F.concat(head, lines, close).alias("text"))
    kind = dict(body.dtypes)
    edges = rows.sparkSession.createDataFrame([(0, "{"), (3, "}")], "section int, text string")
    edges = edges.select("section", F.lit(0).cast(kind["number"]).alias("number"), F.lit(None).cast(kind["first"]).alias("first"), F.lit(0).cast(kind["piece"]).alias("piece"), "text")
    return body.unionByName(edges)


def _literal(row, kind) -> Column:
    """A row of numbers and rows as a column."""
    return F.struct(*[(_literal(row[f.name], f.dataType) if hasattr(f.dataType, "fields") and row[f.name] is not None else F.lit(row[f.name]).cast(f.dataType)).alias(f.name) for f in kind.fields])


ORDER = ("section", "number", "first", "piece")


def write_pretty(pieces: DataFrame, path: str) -> None:
    """Write the indented JSON of an index in pieces as text files: one after
    another, in the order of their names, they are the text of `pretty`, each
    line ended. Executors write ranges of it; nothing is gathered."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fragments(pieces).repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).select("text").write.text(path)


def previewed(pieces: DataFrame, limit: int = PREVIEW_CHARS) -> str:
    """What `shown` gives, from an index in pieces: the running sum of lengths in
    the order of the text tells how far to read. A fragment has a character at
    least, so no more than limit + 1 of them count, each cut to what can show."""
    cut = fragments(pieces).select(*ORDER, F.substring("text", 1, limit + 2).alias("text"))
    first = cut.orderBy(*ORDER).limit(limit + 1)
    before = Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)  # over limit + 1 rows at most
    read = first.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where(F.col("at") <= limit).orderBy("at")
    return preview("\n".join(r["text"] for r in read.select("at", "text").collect()), limit)


def run_facts(spark: SparkSession, query: str, began: float, ended: float, incomplete: bool = False) -> DataFrame:
    """query, elapsed (seconds with two decimals, as text) and incomplete (ended
    by the timer) of a run, as one row to store beside its index."""
    return spark.range(1).select(F.lit(query).alias("query"), F.lit(f"{max(ended - began, 0):.2f}").alias("elapsed"), F.lit(incomplete).alias("incomplete"))


def file_name(host: str, query: str, incomplete: bool = False) -> str:
    """Host and query, with the first operators spelled out."""
    query = re.sub(r"\|\|?", "or", query, count=1)
    query = re.sub(r"&&?", "and", query, count=1)
    return f"{re.sub(r'^www[.]', '', host)}_{query}{'_(INCOMPLETE)' if incomplete else ''}.json"

"""robots.txt: parsing, pattern matching and the allow decision, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(robots: DataFrame) -> DataFrame:
    """origin, line_no, key, value, well_formed of the rules that apply to every
    agent. A rule applies if the last user-agent line above it is `*` or there
    is none; sitemaps always apply; an empty disallow allows `/`. Lines without
    a colon are kept with well_formed false."""
    raw = robots.select("origin", F.posexplode(F.split(F.coalesce("raw_text", F.lit("")), r"\r\n|\r|\n")).alias("line_no", "line"))
    raw = raw.select("origin", "line_no", F.trim(F.regexp_replace("line", r"^[\t ]+|[\t ]+$", "")).alias("line")).where("line <> '' and not startswith(line, '#')")
    colon = F.instr("line", ":")
    split = raw.select(
        "origin", "line_no", (colon > 0).alias("well_formed"),
        F.when(colon > 0, F.lower(F.trim(F.substring_index("line", ":", 1)))).alias("key"),
        F.when(colon > 0, F.trim(F.substr("line", colon + 1))).alias("value"),
    )
    above = Window.partitionBy("origin").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(above)
    named = split.withColumn("agent", F.coalesce(agent, F.lit("*")))
    kept = named.where((~F.col("well_formed")) | (F.col("key") == "sitemap") | (F.col("key").isin("allow", "disallow") & (F.col("agent") == "*")))
    opened = (F.col("key") == "disallow") & (F.col("value") == "")
    return kept.select("origin", "line_no", F.when(opened, "allow").otherwise(F.col("key")).alias("key"), F.when(opened, "/").otherwise(F.col("value")).alias("value"), "well_formed")


def rules(robots: DataFrame, disallow: tuple[str, ...] = (), ignore: bool = False) -> DataFrame:
    """origin, allow, disallow, sitemap, malformed. Patterns of the user count
    even where the file is ignored."""
    own = lines(robots)
    pick = lambda key: F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == key, F.struct("line_no", "value")))), lambda x: x["value"])
    found = own.groupBy("origin").agg(pick("allow").alias("allow"), pick("disallow").alias("disallow"), pick("sitemap").alias("sitemap"), F.count_if(~F.col("well_formed")).alias("malformed"))
    none = F.expr("cast(array() as array<string>)")
    extra = F.array(*map(F.lit, disallow)) if disallow else none
    full = robots.select("origin").distinct().join(found, "origin", "left")
    value = lambda c: none if ignore else F.coalesce(c, none)
    return full.select("origin", value("allow").alias("allow"), F.concat(value("disallow"), extra).alias("disallow"), value("sitemap").alias("sitemap"), F.coalesce("malformed", F.lit(0)).alias("malformed"))


def matches(path: Column, pattern: Column) -> Column:
    """Whether a pattern matches a path: one trailing $ and then trailing * go; a
    rest of at most one character matches all; else the sections between * are
    found left to right, each at its first place after the one before, anywhere
    in the path. With $ the last section so found must end the path."""
    ends = pattern.endswith("$")
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"\*+$", "")
    sections = F.filter(F.split(body, r"\*"), lambda s: s != "")
    at = F.aggregate(
        sections, F.lit(1),
        lambda at, s: F.when((at == 0) | (F.call_function("locate", s, path, at) == 0), F.lit(0)).otherwise(F.call_function("locate", s, path, at) + F.length(s)),
    )
    return (F.length(body) <= 1) | ((at > 0) & (~ends | (at == F.length(path) + 1)))


def allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """Allow beats disallow; without a match a path is allowed."""
    return F.when(F.exists(allow, lambda p: matches(path, p)), True).when(F.exists(disallow, lambda p: matches(path, p)), False).otherwise(True)


def path_of(url: Column, origin: str) -> Column:
    """A URL of the site without its origin; NULL for a URL of another one."""
    return F.when(F.substring(F.concat(url, F.lit("/")), 1, len(origin) + 1).isin(*[origin + c for c in "/?#"]), F.substr(url, F.lit(len(origin) + 1)))

"""Inputs of an audit and checks of their schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGES = "page_id bigint, url string, html string"
FETCHES = "url string, status int, content_type string, response_url string, timed_out boolean"
IMAGES = "src string, loaded boolean, natural_width int, natural_height int"
ROBOTS = "origin string, raw_text string"


def checked(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of the schema, or an error that names what is wrong."""
    wanted = StructType.fromDDL(ddl)
    have = {f.name: f.dataType for f in df.schema}
    for f in wanted:
        if f.name not in have:
            raise ValueError(f"column {f.name} is missing")
        if have[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*wanted.names)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark.read.parquet(f"{sf_dir}/pages.parquet"), PAGES)


def fetches(df: DataFrame) -> DataFrame:
    """One outcome for each url: a page is requested once (the least of several)."""
    names = StructType.fromDDL(FETCHES).names
    return checked(df, FETCHES).groupBy("url").agg(F.min(F.struct(*names[1:])).alias("o")).select("url", "o.*")


def parsed(pages: DataFrame, fetches: DataFrame) -> DataFrame:
    """Pages whose fetch brought HTML: status 200, in time, of a type that is
    missing or HTML. A page without an outcome is not parsed."""
    html = F.col("content_type").isNull() | F.col("content_type").startswith("text/html")
    good = fetches.where((F.col("status") == 200) & ~F.coalesce("timed_out", F.lit(False)) & html)
    return pages.join(good.select("url"), "url", "left_semi")


def robots(df: DataFrame) -> DataFrame:
    """Raw robots text by origin; null where there is none."""
    return checked(df, ROBOTS)


def images(df: DataFrame) -> DataFrame:
    """One row for each src: an image is loaded once."""
    return checked(df, IMAGES).dropDuplicates(["src"])


@dataclass(frozen=True)
class StartPage:
    """The page a crawl starts from, as the row that stands for it."""

    url: str

    def row(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(F.lit(self.url).alias("url"))

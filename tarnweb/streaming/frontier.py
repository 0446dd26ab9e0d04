"""Streaming audit: classification is stateless, the frontier is not.

Pages arrive as a stream; their elements are extracted and labelled by the same
expressions as in batch. URLs not seen before come out once each, within the
watermark, so state is bounded by the rate of new URLs and not by the site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, labels
from ..plans.options import AuditOptions, SiteContext
from ..sources.tables import PAGES


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def classified(pages: DataFrame, site: SiteContext, options: AuditOptions = AuditOptions()) -> DataFrame:
    return labels.classify(extract.located(extract.elements(pages)), site, options)


def new_urls(pages: DataFrame, site: SiteContext, options: AuditOptions = AuditOptions(), delay: str = "1 hour") -> DataFrame:
    """seen_at, group_name of internal link targets, once each."""
    found = classified(pages, site, options).where(labels.flag("internal") & (F.col("kind") == "link"))
    timed = found.select(F.current_timestamp().alias("seen_at"), "group_name").withWatermark("seen_at", delay)
    return timed.dropDuplicatesWithinWatermark(["group_name"])

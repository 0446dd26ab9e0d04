"""An audit's records from its pages, as the options ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.options import AuditOptions, SiteContext
from . import extract, labels


def flagged(pages: DataFrame, site: SiteContext, options: AuditOptions = AuditOptions(), images: DataFrame | None = None, start: bool = True) -> DataFrame:
    """Classified elements of pages and, with start, the start page's own row."""
    found = extract.audited(pages, options)
    if start:
        found = found.unionByName(extract.start_page(site, found))
    return labels.classify(extract.located(found), site, options, images)


def records(pages: DataFrame, site: SiteContext, options: AuditOptions = AuditOptions(), images: DataFrame | None = None, start: bool = True, *more: DataFrame) -> DataFrame:
    """Records with both levels of labels. more: tables of group_name and bits,
    such as fetch outcomes or what a crawl has reached."""
    return labels.rolled(flagged(pages, site, options, images, start), *more)

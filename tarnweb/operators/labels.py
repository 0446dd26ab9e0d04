"""The 31 labels: element labels of records, group labels of distinct URLs.

Each label is one predicate; a record's labels are one integer column, `bits`.
Group labels are rolled up with bit_or by group and joined back, so every record
of a URL sees them. One column keeps rows narrow and plans small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.options import AuditOptions, SiteContext
from ..storage import stored

ELEMENT_LABELS = ("link", "image", "iframe", "startPage", "bannedString", "absoluteInternal", "anchor", "improperSize", "noAltText", "emptyTitle", "userSelected")
GROUP_LABELS = (
    "internal", "external", "null", "email", "localFile", "javascriptLink", "http-httpsError", "unusualScheme", "visited", "unknownContentType",
    "redirects", "accessDenied", "forbidden", "notFound", "internalServiceError", "gatewayTimeout", "robotsDisallowed", "unloaded", "file", "badRequest",
)
#: HTTP status -> label (fixed values). Status 0 stands for a refused redirect.
STATUS = {0: "redirects", 400: "badRequest", 401: "accessDenied", 403: "forbidden", 404: "notFound", 500: "internalServiceError", 504: "gatewayTimeout"}
#: Name in queries -> place of its bit.
PLACES = {n: i for i, n in enumerate(ELEMENT_LABELS + GROUP_LABELS)}
GROUP_MASK = sum(1 << PLACES[n] for n in GROUP_LABELS)
ELEMENT_MASK = sum(1 << PLACES[n] for n in ELEMENT_LABELS)

#: A decimal number as attributes write it: sign, fraction and exponent are optional.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def flag(label: str, bits: str = "bits") -> Column:
    """Whether a label is set."""
    return F.col(bits).bitwiseAND(F.lit(1 << PLACES[label]).cast("long")) != 0


def packed(flags: dict[str, Column]) -> Column:
    """bits of some flags; NULL counts as not set."""
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(1 << PLACES[n])).otherwise(F.lit(0)).cast("long") for n, c in flags.items()])




def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def classify(located: DataFrame, site: SiteContext, options: AuditOptions = AuditOptions(), images: DataFrame | None = None) -> DataFrame:
    """Adds a flag for each label that follows from elements (and images)."""
    has_images = images is not None
    df = located
    if has_images:
        df = df.join(images.withColumnRenamed("src", "_src"), (F.col("kind") == "image") & (df["url_prop"] == F.col("_src")), "left")
    kind, attr, prop = F.col("kind"), F.col("url_attr"), F.col("url_prop")
    p = urls.stored_parts()
    link, frame_like = kind == "link", kind.isin("image", "iframe")
    there = attr.isNotNull()
    bad = urls.banned(prop, options.banned)
    web = p.scheme.isin("http", "https")
    same = p.host == site.hostname
    clear = link & there & ~bad
    internal = (clear & web & same) | (frame_like & there & same)
    related = F.col("related") if "related" in df.columns else F.lit(False)
    sized = lambda side: F.col(side).isNotNull() & ~_false(
        F.when(F.trim(side) == "", F.lit(0.0)).when(F.trim(side).rlike(NUMBER), F.trim(side).cast("double")) == F.col(f"natural_{side}")
    )
    flags: dict[str, Column] = {
        "link": link,
        "image": kind == "image",
        "iframe": kind == "iframe",
        "startPage": kind == "start",
        "userSelected": (kind == "selected") | (F.col("selected") if "selected" in df.columns else F.lit(False)),
        "bannedString": (link | frame_like) & there & bad,
        "anchor": clear & (p.hash != ""),
        "absoluteInternal": F.when(link, internal & (attr == F.lower(prop)) & (~related if options.exclude_related_links else F.lit(True))).otherwise(internal & (attr == prop)),
        "noAltText": (kind == "image") & there & (F.coalesce(F.col("alt"), F.lit("")) == ""),
        "emptyTitle": (kind == "iframe") & there & (F.coalesce(F.col("title"), F.lit("")) == ""),
        "improperSize": (kind == "image") & there & F.col("loaded") & (sized("width") | sized("height")) if has_images else F.lit(False),
        "internal": internal,
        "external": (clear & web & ~same) | (frame_like & there & ~_false(same)),
        "null": (link | frame_like) & ~there,
        "email": clear & (p.scheme == "mailto"),
        "localFile": (clear | (frame_like & there)) & (p.scheme == "file"),
        "javascriptLink": clear & (p.scheme == "javascript"),
        "http-httpsError": (clear & web & (p.scheme != site.scheme)) | (frame_like & there & (p.scheme != "file") & (p.scheme != site.scheme)),
        "unusualScheme": clear & ~p.scheme.isin("http", "https", *urls.RECOGNISED),
        "visited": (kind == "start") | ((kind == "image") & there & F.col("loaded").isNotNull() if has_images else F.lit(False)),
        "unloaded": (kind == "image") & there & ~F.col("loaded") if has_images else F.lit(False),
    }
    out = df.withColumn("bits", packed(flags))
    return out.drop("_src", "loaded", "natural_width", "natural_height") if has_images else out


def fetch_flags(fetches: DataFrame) -> DataFrame:
    """group_name and the labels that follow from a fetch. A present content
    type other than HTML ends the fetch at its headers, so no status counts; a
    missing one does not."""
    aborted = F.col("content_type").isNotNull() & ~F.col("content_type").startswith("text/html")
    seen = ~aborted & ~F.coalesce("timed_out", F.lit(False))
    response = F.coalesce("response_url", "url")
    flags = {label: seen & (F.col("status") == status) for status, label in STATUS.items()}
    flags["file"] = urls.is_file(response)
    flags["unknownContentType"] = F.col("content_type").isNull() | (aborted & ~urls.is_file(response))
    return fetches.select(urls.without_fragment(F.col("url")).alias("group_name"), packed(flags).alias("bits"))


def roll_up(flagged: DataFrame, *more: DataFrame) -> DataFrame:
    """groups: group_name, n_records, bits of the group labels. `more` are
    tables of group_name and bits, such as fetch_flags or crawl results."""
    rows = [flagged.select("group_name", F.lit(1).alias("n"), "bits"), *[m.select("group_name", F.lit(0).alias("n"), "bits") for m in more]]
    grouped = reduce(DataFrame.unionByName, rows).groupBy("group_name")
    return grouped.agg(F.sum("n").alias("n_records"), F.bit_or(F.col("bits").bitwiseAND(F.lit(GROUP_MASK))).alias("bits")).where("n_records > 0")


def records(flagged: DataFrame, groups: DataFrame) -> DataFrame:
    """Elements with both levels of labels in bits."""
    own = flagged.withColumn("bits", F.col("bits").bitwiseAND(F.lit(ELEMENT_MASK)))
    both = own.join(groups.select("group_name", F.col("bits").alias("group_bits")), "group_name")
    return both.withColumn("bits", F.col("bits").bitwiseOR(F.col("group_bits"))).drop("group_bits")


#: What queries and indexes need of a record.
KEPT = ("page_id", "document", "kind", "node_pos", "markup", "url_attr", "url_prop", "group_name", "selected", "tree_pos", "bits")


def rolled(flagged: DataFrame, *more: DataFrame) -> DataFrame:
    """Elements with both levels of labels. Pages are read and elements classified
    once: the groups and the records both come from the table written here."""
    own = stored(flagged.select(*[c for c in KEPT if c in flagged.columns]), "flagged")
    return records(own, roll_up(own, *more))


def label_names(bits: str = "bits") -> Column:
    """Array of the names of the labels set."""
    return F.array_compact(F.array(*[F.when(flag(n, bits), F.lit(n)) for n in PLACES]))


def labelled(df: DataFrame, label: str) -> DataFrame | None:
    """Records with a label; None for an unknown one."""
    return df.where(flag(label)) if label in PLACES else None

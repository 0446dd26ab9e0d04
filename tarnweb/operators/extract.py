"""Elements of pages: links, images, iframes, selected elements, start page.

The fast path finds elements of all kinds with one regular expression and one
scan; html is dropped in the same stage. Comments and scripts are blanked first.
Selectors need a tree and run in Arrow batches (:mod:`.selectors`). With a selector
all elements come from the trees, each once: a selected link is one record with
both labels, whose group keeps the fragment, as selection comes before links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import MARKUP_CHARS, truncated_markup
from ..plans.options import AuditOptions, SiteContext

TAGS = {"image": "img", "iframe": "iframe", "link": "a"}
ORDER = {"image": 0, "iframe": 1, "selected": 2, "link": 3}
ATTRIBUTES = ("href", "src", "alt", "title", "width", "height")
#: Class of blocks of related links (fixed value).
RELATED = "field-name-field-related-links"
#: Elements that have an href or a src property (fixed values).
WITH_HREF = ("A", "AREA", "LINK", "BASE")
WITH_SRC = ("IMG", "IFRAME", "FRAME", "SCRIPT", "EMBED", "AUDIO", "VIDEO", "SOURCE", "TRACK", "INPUT")
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


#: What follows the name in a start tag.
REST_OF_TAG = r"""(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


def tag_pattern(tags: tuple[str, ...]) -> str:
    """A start tag. Nothing beyond it is read, and no other tag starts in it."""
    return rf"(?is)<(?:{'|'.join(tags)}){REST_OF_TAG}"


def outer_pattern(tags: tuple[str, ...]) -> str:
    """Group 1 is an element from its start tag on, with as much of its content
    as is ever shown. Only the start tag is passed over, so elements inside
    others are found too."""
    attrs = REST_OF_TAG
    inside = {"a": r"</?a[\s/>]", "iframe": r"</iframe[\s/>]"}
    wholes = [rf"<{t}{attrs}" + (rf"(?:(?!{inside[t]}).){{0,{MARKUP_CHARS + 1}}}+(?:</{t}\s*>)?" if t in inside else "") for t in tags]
    return rf"(?is)(?=({'|'.join(wholes)}))<(?:{'|'.join(tags)}){attrs}"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag: NULL if absent, '' without a value.
    Quoted values are passed over as wholes, so text inside them names nothing."""
    value = r"(?:\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']*+))?"
    pattern = rf"(?is)^<[a-z0-9]++(?:[\s/]++(?!{name}[\s=/>])[^\s=>\"'/]++{value})*+[\s/]++{name}(?=[\s=/>])({value})"
    raw = F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"(?s)^\s*=\s*[\"']?|[\"']$", "")
    plain = raw
    for entity, text in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(text))
    return F.when(F.lower(tag).contains(name) & tag.rlike(pattern), plain)


def elements(pages: DataFrame, kinds: tuple[str, ...] = ("image", "iframe", "link"), content: bool = True) -> DataFrame:
    """page_id, document, kind, node_pos (place among the page's elements of the
    kind), markup and the attributes of every element of the kinds asked for.
    markup is the outer HTML, cut beyond what is shown of it; without content, for
    results that do not show it, the start tag, which takes a simpler expression."""
    tags = tuple(TAGS[k] for k in kinds)
    pattern, group = (outer_pattern(tags), 1) if content else (tag_pattern(tags), 0)
    pages = pages.select("page_id", F.col("url").alias("document"), F.regexp_extract_all(F.regexp_replace("html", HIDDEN, " "), F.lit(pattern), F.lit(group)).alias("_all"))
    of_kind = (lambda k: F.col("_all")) if len(kinds) == 1 else (lambda k: F.filter("_all", lambda m: m.rlike(rf"(?i)^<{TAGS[k]}[\s/>]")))
    numbered = lambda k: F.transform(of_kind(k), lambda m, i: F.struct(F.lit(k).alias("kind"), i.cast("int").alias("node_pos"), m.alias("markup")))
    out = pages.select("page_id", "document", F.inline(F.concat(*map(numbered, kinds))))
    markup = _closed(F.col("kind"), F.col("markup")) if content else F.col("markup")
    return out.select("page_id", "document", "kind", "node_pos", markup.alias("markup"), *[attribute(F.col("markup"), a).alias(a) for a in ATTRIBUTES])


def _closed(kind: Column, markup: Column) -> Column:
    """Markup with the end tag that its page left out."""
    ends = {"link": "a", "iframe": "iframe"}
    return reduce(lambda m, k: F.when((kind == k) & ~markup.rlike(rf"(?i)</{ends[k]}\s*>$"), F.concat(markup, F.lit(f"</{ends[k]}>"))).otherwise(m), ends, markup)


def with_related(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds `related`: whether a link lies in a block of related links. Trees are
    built only of pages that name such a block."""
    from .selectors import select_places

    inside = select_places(pages.where(F.col("html").contains(RELATED)), f".{RELATED} a").where("tag = 'a'")
    inside = inside.select("page_id", F.lit("link").alias("kind"), F.col("tag_pos").alias("node_pos"), F.lit(True).alias("related")).distinct()
    return found.join(inside, ["page_id", "kind", "node_pos"], "left").select(*found.columns, F.coalesce("related", F.lit(False)).alias("related"))


def start_page(site: SiteContext, like: DataFrame) -> DataFrame:
    """The row that stands for the start page: a link to itself."""
    row = like.sparkSession.range(1).select(
        F.lit(-1).cast("bigint").alias("page_id"), F.lit(site.start_page).alias("document"), F.lit("start").alias("kind"), F.lit(0).alias("node_pos"),
        F.lit("<a>").alias("markup"), F.lit(site.start_page).alias("href"),
    )
    return row.select(*[row[c] if c in row.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns])


def audited(pages: DataFrame, options: AuditOptions) -> DataFrame:
    """Elements of pages as the options ask for them, not yet located."""
    if options.selector is None:
        return elements(pages)
    from .selectors import page_elements

    return page_elements(pages, options.selector)


def located(found: DataFrame) -> DataFrame:
    """Adds url_attr, url_prop, its parts and group_name."""
    tag = F.upper(F.regexp_extract("markup", r"^<([A-Za-z0-9]+)", 1))
    picked = F.col("kind") == "selected"
    step = found.withColumn("url_attr", F.coalesce(F.col("href"), F.col("src")))
    owned = F.when(tag.isin(*WITH_HREF), F.col("href")).when(tag.isin(*WITH_SRC), F.col("src"))
    step = urls.with_resolved(step, F.when(picked, owned).otherwise(F.col("url_attr")), F.col("document"), "url_prop")
    step = urls.with_parts(step.withColumn("url_prop", F.coalesce("url_prop", F.lit(""))), "url_prop")
    bare = F.when(F.col("url_prop") == "", "").otherwise(F.concat("url_origin", "url_path", "url_search"))
    with_href = F.col("kind").isin("link", "start") | F.col("href").isNotNull()
    group = F.when(picked, F.when(tag.isin(*WITH_HREF, *WITH_SRC), F.col("url_prop")).otherwise(tag))
    if "selected" in found.columns:
        group = group.when((F.col("kind") == "link") & F.col("selected"), F.col("url_prop"))
    group = group.when(with_href, bare).otherwise(F.col("url_prop"))
    # One generated row a row: filters on these columns, which a join adds, stay
    # above it instead of being written out over all the steps below.
    made = F.array(F.struct("url_attr", "url_prop", *urls.PART_COLUMNS, group.alias("group_name")))
    return step.select(*found.columns, F.inline(made))


def ordering(selection: bool = False) -> list[Column]:
    """Record order: page, then kind, then place in the page. selection: rows
    have `selected`; then selected elements that are not images or iframes come
    between those and links, in the order of the tree."""
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, ORDER[k]), ORDER, F.when(F.col("kind") == "start", -1))
    place = F.col("node_pos")
    if selection:
        moved = F.col("selected") & F.col("kind").isin("link", "selected")
        rank, place = F.when(moved, ORDER["selected"]).otherwise(rank), F.when(moved, F.col("tree_pos")).otherwise(place)
    return [F.col("page_id"), rank, place]


def record_key(selection: bool = False) -> Column:
    """A sortable value that identifies a record, without numbering them all."""
    page, rank, place = ordering(selection)
    return F.struct(page.alias("page"), rank.alias("rank"), place.alias("place"))


def display(markup: Column) -> Column:
    return truncated_markup(markup)

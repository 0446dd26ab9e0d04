"""Queries on stored indexes, selected elements, the start page and deep sites,
with the SQL that says what they compute (see catalogue for the sources E, S, D)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as base
from .operators import audit, closure, index, labels
from .operators.label_index import LabelIndex, build, n_matching
from .plans.language import run_query
from .plans.options import parse_flags
from .sources import outputs
from .storage import new_path, stored

TEXTS = ("internal", "internal & anchor", "internal | http-httpsError", "!external", "link & (internal, !http-httpsError) and not anchor", "!(anchor | !internal) & link", "email")
PAIRS = (("internal", "anchor", "and"), ("internal", "http-httpsError", "or"), ("internal", "anchor", "xor"), ("external", "anchor", "difference"), ("internal", "http-httpsError", "neither"), ("internal", "anchor", "or_not"))
#: Pages whose links the selector below takes, and headings that are no links.
FLAGS = "-select'nav li > a[href^=\"/\"], h1, img' -ignoreBannedStr"
PIECE = 7


def stored_index(records: DataFrame) -> LabelIndex:
    """An index in the shared folder, for the queries of this module."""
    spark = records.sparkSession
    path = new_path(spark, "labels")
    build(stored(records, "records"), path)
    return LabelIndex(spark, path)


def _stored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored_index(base._records(spark, sf_dir))
    parts = [found.query(t).select(F.lit(t).alias("query"), "page_id", "url_attr") for t in TEXTS]
    return reduce(DataFrame.unionByName, parts)


def _stored_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored_index(base._records(spark, sf_dir))
    parts = [found.combine(a, b, how).select(F.lit(how).alias("how"), "page_id") for a, b, how in PAIRS]
    parts.append(found.parity(["internal", "anchor", "http-httpsError"]).select(F.lit("parity").alias("how"), "page_id"))
    parts.append(found.complement("external").select(F.lit("complement").alias("how"), "page_id"))
    return reduce(DataFrame.unionByName, parts)


def _stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of answers from bitmaps alone, over the links in pages."""
    flagged = labels.classify(base._links(spark, sf_dir), base.site_of(base._pages(spark, sf_dir)), base.OPTIONS)
    found = stored_index(labels.rolled(flagged))
    return reduce(DataFrame.unionByName, [found.matching(t).agg(n_matching(F.col("hits")).alias("n")).select(F.lit(t).alias("query"), "n") for t in TEXTS])


def _selected(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = audit.records(base._site_pages(spark, sf_dir), base.CRAWL_SITE, parse_flags(FLAGS))
        return run_query(records, text, labels.PLACES, labels.flag).select("page_id", "kind", "node_pos", "url_attr", "group_name")

    return run


def _start_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the start page's URL: visited, as its own record says so."""
    records = audit.records(base._site_pages(spark, sf_dir), base.CRAWL_SITE, base.OPTIONS)
    found = run_query(records, "visited & !image", labels.PLACES, labels.flag)
    return found.select("page_id", "kind", "url_attr", labels.flag("startPage").alias("is_startpage"))


def _inverted_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link_pieces(spark, sf_dir).select("key", F.col("piece").cast("bigint").alias("piece"), F.array_join("values", "\n").alias("vals"))


def _link_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.pieces(base._links(spark, sf_dir, True), "(link)", True, PIECE)


def _written_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the indented JSON that executors have written."""
    path = new_path(spark, "json")
    outputs.write_pretty(_link_pieces(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = outputs.previewed(_link_pieces(spark, sf_dir))
    return spark.range(1).select(F.lit(text).alias("text"))


def _crawl_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deep site: each page links to the next, some to others, and a few pages
    stand in circles that nothing leads into."""
    k = F.col("page_id")
    pages = base._pages(spark, sf_dir).select("page_id")
    n = pages.count()
    chain = pages.where(k % 40 != 39).select(k.alias("src"), (k + 1).alias("dst"))
    jumps = pages.where(k % 25 == 3).select(k.alias("src"), (k + 37).alias("dst"))
    back = pages.where(k % 6 == 5).select(k.alias("src"), F.floor(k / 2).alias("dst"))
    edges = chain.unionByName(jumps).unionByName(back).where(F.col("dst") < n)
    found = closure.closure(edges, pages.where("page_id = 0").select(k.alias("node")))
    return found.select(F.col("node").alias("page_id"), "depth")


QUERIES = {
    "stored_queries": _stored_queries,
    "stored_sets": _stored_sets,
    "stored_counts": _stored_counts,
    "select_and_link": _selected("userSelected & link"),
    "select_not_link": _selected("userSelected & !link"),
    "start_page": _start_page,
    "inverted_pieces": _inverted_pieces,
    "written_json": _written_json,
    "preview_index": _previewed,
    "crawl_chain": _crawl_chain,
}

_WHERE = dict(zip(TEXTS, ("internal", "internal AND anchor", "internal OR mismatch", "NOT external", "(internal OR NOT mismatch) AND NOT anchor", "NOT anchor AND internal", "false")))
_HOW = dict(zip([p[2] for p in PAIRS], ("internal AND anchor", "internal OR mismatch", "internal <> anchor", "external AND NOT anchor", "NOT (internal OR mismatch)", "internal OR NOT anchor"))) | {"parity": "(internal <> anchor) <> mismatch", "complement": "NOT external"}
_ALL = " UNION ALL "
_D_LINKS = base._E.replace("FROM pages", "FROM d")
#: Places of links that lie in a list of the navigation: its links come first.
_NAV = r"""n AS (SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<a href="/')) AS in_nav FROM d)"""
_LINES = f"""{base._E}, k AS (SELECT url_prop AS key, url, row_number() OVER (PARTITION BY url_prop ORDER BY page_id, node_pos) AS rn, count(*) OVER (PARTITION BY url_prop) AS n, first_value(page_id * 100000 + node_pos) OVER (PARTITION BY url_prop ORDER BY page_id, node_pos) AS f FROM e),
  l AS (SELECT 0 AS f, 0 AS rn, '{{' AS line UNION ALL SELECT f + 1, 0, '  "' || key || '": [' FROM k WHERE rn = 1 UNION ALL SELECT f + 1, rn, '    "' || url || '"' || CASE WHEN rn < n THEN ',' ELSE '' END FROM k
    UNION ALL SELECT f + 1, n + 1, '  ]' || CASE WHEN f < (SELECT max(f) FROM k) THEN ',' ELSE '' END FROM k WHERE rn = 1 UNION ALL SELECT (SELECT max(f) FROM k) + 2, 0, '}}')"""

SQL = {
    "stored_queries": f"WITH {base._S} " + _ALL.join(f"SELECT '{t}' AS query, page_id, url AS url_attr FROM s WHERE {w}" for t, w in _WHERE.items()),
    "stored_sets": f"WITH {base._S} " + _ALL.join(f"SELECT '{h}' AS how, page_id FROM s WHERE {w}" for h, w in _HOW.items()),
    "stored_counts": f"""WITH {base._E}, h AS (SELECT {base._HOST} AS host FROM pages GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
      x AS (SELECT url_prop, regexp_extract(url_prop, '^[a-z]+://([^/?#]*)', 1) AS host, starts_with(url_prop, 'http:') AS plain, regexp_matches(url_prop, '#.') AS anchor,
        contains(lower(url_prop), 'spam-farm') OR contains(lower(url_prop), 'cheap-pills') AS bad FROM e),
      s AS (SELECT NOT bad AND anchor AS anchor, bool_or(NOT bad AND x.host = h.host) OVER g AS internal, bool_or(NOT bad AND x.host <> h.host) OVER g AS external, bool_or(NOT bad AND plain) OVER g AS mismatch
        FROM x, h WINDOW g AS (PARTITION BY regexp_replace(url_prop, '#.*$', ''))) """ + _ALL.join(f"SELECT '{t}' AS query, count(*) FILTER ({w})::BIGINT AS n FROM s" for t, w in _WHERE.items()),
    "select_and_link": f"""WITH {base._D}, {_D_LINKS}, {_NAV}
      SELECT page_id, 'link' AS kind, node_pos, url_attr, url_prop AS group_name FROM e JOIN n USING (page_id) WHERE node_pos < in_nav""",
    "select_not_link": f"""WITH {base._D}, t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<script[^>]*>).*?</script>', '\\1', 'g') AS html FROM d),
      x AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1)::INT - 1 AS node_pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)<[a-z][^>]*>') AS tags FROM t))
      SELECT page_id, 'selected' AS kind, node_pos, NULL AS url_attr, 'H1' AS group_name FROM x WHERE tag = '<h1>'
      UNION ALL SELECT page_id, 'image', 0, '/i/' || (page_id % 7) || '.png', 'https://crawl.test/i/' || (page_id % 7) || '.png' FROM d""",
    "start_page": "SELECT -1::BIGINT AS page_id, 'start' AS kind, 'https://crawl.test/p/0' AS url_attr, true AS is_startpage UNION ALL SELECT page_id, 'link', '/p/0', false FROM pages WHERE page_id // 3 = 0",
    "inverted_pieces": f"""WITH {base._E}, x AS (SELECT url_prop AS key, url, page_id, node_pos, (row_number() OVER (PARTITION BY url_prop ORDER BY page_id, node_pos) - 1) // {PIECE} AS piece FROM e)
      SELECT key, piece::BIGINT AS piece, string_agg(url, chr(10) ORDER BY page_id, node_pos) AS vals FROM x GROUP BY key, piece""",
    "written_json": f"WITH {_LINES} SELECT line FROM l",
    "preview_index": f"""WITH {_LINES}, z AS (SELECT string_agg(line, chr(10) ORDER BY f, rn) AS text FROM l)
      SELECT CASE WHEN length(text) <= 5000 THEN text ELSE regexp_replace(substr(text, 1, 5001), '(?s)\n[^\n]*$', '') || chr(10) || '...' END AS text FROM z""",
    "crawl_chain": """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), e AS (SELECT page_id AS src, page_id + 1 AS dst FROM pages WHERE page_id % 40 <> 39 UNION SELECT page_id, page_id + 37 FROM pages WHERE page_id % 25 = 3
        UNION SELECT page_id, page_id // 2 FROM pages WHERE page_id % 6 = 5),
      r(node, depth) AS (SELECT page_id, 0 FROM pages WHERE page_id = 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node, n WHERE e.dst < n.n AND r.depth < n.n)
      SELECT node AS page_id, min(depth)::INT AS depth FROM r GROUP BY node""",
}

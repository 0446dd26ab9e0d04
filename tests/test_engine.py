import duckdb
import pytest

import __spark_entry__
from tarnweb import catalogue
from tarnweb.functions import urls
from tarnweb.operators import closure, extract, index, labels, robots, selectors, sets
from tarnweb.plans.language import run_query
from tarnweb.plans.options import AuditOptions
from tarnweb.sources import outputs, tables
from tarnweb.streaming import frontier
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    return c


@pytest.mark.parametrize("name", ["resolve_urls", "url_tokens", "label_counts", "scheme_labels", "image_labels", "iframe_labels", "fetch_labels", "query_nested", "set_parity", "forward_index", "robots_parse", "robots_match", "robots_allowed", "crawl_closure", "crawl_site", "crawl_one_page", "extract_links", "extract_images", "extract_iframes", "index_complex", "css_select", "fuzzy_suggest", "preview_truncate"])
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["key", "vals", "n"]
    assert set(catalogue.SQL) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_resolution(spark):
    cases = [
        ("https://X.com", "https://x.com/"), ("//H.test/a", "https://H.test/a".replace("H", "h")), ("../c?q#f", "https://site.test/c?q#f"), ("./", "https://site.test/a/"), ("?x", "https://site.test/a/b?x"),
        ("#x", "https://site.test/a/b#x"), ("", "https://site.test/a/b"), ("/è ê", "https://site.test/%C3%A8%20%C3%AA"), ("mailto:A@b", "mailto:A@b"), ("http://a.test:80/", "http://a.test/"), (None, None), ("\\x", "https://site.test/x"),
    ]
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, r string")
    got = urls.with_resolved(rows, F.col("r"), F.lit("https://site.test/a/b"), "out").orderBy("i").collect()
    assert [r["out"] for r in got] == [w for _, w in cases]


def test_tokens(spark):
    rows = spark.createDataFrame([("foo://example.com:8042/over/there?name=ferret#nose",), ("urn:example:animal",), ("/a:b",), ("x",), ("a:",), (None,)], "u string")
    got = [tuple(r["t"]) if r["t"] else None for r in rows.select(urls.tokens(F.col("u")).alias("t")).collect()]
    assert got == [("foo", "example.com:8042", "over/there", "name=ferret", "nose"), ("urn", None, "example:animal", None, None), None, None, ("a", None, "", None, None), None]


@pytest.mark.parametrize(
    "path, pattern, hit",
    [("/x/about/y", "/about/", True), ("/d/l.php", "/*.php$", True), ("/my.php.data/s.txt", "/*.php$", False), ("/a.php/b.php", "/*.php$", False), ("", "a", True), ("", "/ab", False), ("/b/a", "/a*$", True), ("/x1y2", "/x*y", True), ("/q", "", True), ("/q", "$", True)],
)
def test_robots_pattern(spark, path, pattern, hit):
    assert spark.range(1).select(robots.matches(F.lit(path), F.lit(pattern)).alias("m")).first()["m"] is hit


def test_pages_and_sets(spark):
    html = """<!-- <a href="/no"> --><script>"<a href='/no'>"</script><A HREF='/One#x'>1</A><a>2</a><a title="href=&quot;/no&quot;" href=/two>3</a><a href="">4</a><img src="/i.png"><iframe src="http://o.test/"></iframe>"""
    pages = spark.createDataFrame([(1, "https://site.test/a/", html), (2, "https://site.test/b", None)], "page_id bigint, url string, html string")
    flagged = labels.classify(extract.located(extract.elements(pages)), catalogue.TEST_SITE, AuditOptions())
    records = labels.records(flagged, labels.roll_up(flagged))
    got = {(r["kind"], r["node_pos"]): (r["url_attr"], r["group_name"], r["names"]) for r in records.withColumn("names", F.array_sort(labels.label_names())).collect()}
    assert got["link", 0] == ("/One#x", "https://site.test/One", ["anchor", "internal", "link"])
    assert got["link", 1] == (None, "", ["link", "null"])
    assert got["link", 2][0] == "/two" and got["link", 3][:2] == ("", "https://site.test/a/")
    assert "noAltText" in got["image", 0][2] and {"external", "http-httpsError", "emptyTitle"} <= set(got["iframe", 0][2])
    with_id = records.withColumn("record_id", F.concat_ws(":", "page_id", "kind", "node_pos"))
    for query in ("internal & !anchor", "!(link | image)", "null, external", "link & (anchor | null)"):
        plain = {r[0] for r in run_query(with_id, query, labels.PLACES, labels.flag).select("record_id").collect()}
        assert plain == {r[0] for r in sets.by_sets(with_id, query).collect()}
    assert run_query(records, " link ", labels.PLACES, labels.flag) is None and run_query(records, "a & nothing", labels.PLACES, labels.flag) is None
    found = index.index(run_query(records, "(link)", labels.PLACES, labels.flag), "(link)").first()
    assert found["key"] == "https://site.test/a/" and list(found["values"]) == ["/One#x", "<a>2</a>", "/two", ""]


def test_deep_closure(spark):
    """A chain of pages longer than any fixed number of rounds is followed to its end, unless a depth is asked for."""
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(55)] + [("p55", "p0")], "src string, dst string").coalesce(1).cache()
    seeds = spark.createDataFrame([("p0",)], "node string")
    assert AuditOptions().max_depth is None
    assert {r["node"]: r["depth"] for r in closure.closure(edges, seeds).collect()} == {f"p{i}": i for i in range(56)}
    assert closure.closure(edges, seeds, 2).count() == 3


def test_outer_html(spark):
    """Elements inside others are found once each, long contents are cut, end tags that are left out are added."""
    html = '<a>one <img src="/i.png"> two</a><a title="<img src=/no>">' + "x" * 100_000 + "</a><a>open" + "<a href=/x" + " y" * 20_000
    pages = spark.createDataFrame([(1, "https://site.test/", html), (2, "https://site.test/e", "")], "page_id bigint, url string, html string")
    got = {(r["kind"], r["node_pos"]): r["m"] for r in extract.elements(pages).withColumn("m", extract.display(F.col("markup"))).collect()}
    assert got["link", 0] == '<a>one <img src="/i.png"> two</a>' and got["image", 0] == '<img src="/i.png">' and len(got) == 4
    assert got["link", 1].startswith('<a title="<img src=/no>">xxx') and len(got["link", 1]) == 83 and got["link", 2].startswith("<a>open")


def test_related(spark):
    block = '<a href="https://site.test/x">1</a><div class="a field-name-field-related-links"><p><a href="https://site.test/x">2</a></p></div><a href="https://site.test/x">3</a>'
    pages = spark.createDataFrame([(1, "https://site.test/", block), (2, "https://site.test/b", "<a href='https://site.test/x'>"), (3, None, None)], "page_id bigint, url string, html string")
    found = extract.with_related(extract.located(extract.elements(pages)), pages)
    flags = lambda o: {(r["page_id"], r["node_pos"]): r["f"] for r in labels.classify(found, catalogue.TEST_SITE, o).select("page_id", "node_pos", labels.flag("absoluteInternal").alias("f")).collect()}
    assert flags(AuditOptions()) == {(1, 0): True, (1, 1): False, (1, 2): True, (2, 0): True}
    assert all(flags(AuditOptions(exclude_related_links=False)).values())


@pytest.mark.parametrize(
    "selector, ids",
    [("li + li", "bcd"), ("#a ~ li", "bcd"), ("li:not(.x)", "bd"), ("li:not(.x, #d)", "b"), ("li:nth-child(2n+1)", "ac"), ("li:nth-child(-n+2)", "ab"), ("li:nth-child(3)", "c"), ("li:first-child", "a"), ("ul > :last-child", "d"),
     ("[class~=y]", "c"), ("[lang|=en]", "bd"), ("p:only-child", "e"), ("li.x + li.x", ""), ("ul li ~ #d", "d")],
)
def test_selectors(selector, ids):
    tree = selectors._Tree('<ul><li id=a class="x z"></li><li id=b lang=en></li><li id=c class="x y"></li><li id=d lang=en-GB></li></ul><div><p id=e></p></div>')
    chains = selectors.compile_selector(selector)
    assert "".join(n.attrs["id"] for n in tree.nodes if any(selectors.selects(c, n) for c in chains)) == ids


@pytest.mark.parametrize("selector", ["a:hover", "a >", "li:nth-child(x)", ":not()", "a::before", ""])
def test_unknown_selectors(selector):
    with pytest.raises(ValueError):
        selectors.compile_selector(selector)


def test_deep_markup():
    assert len(selectors._Tree("<b>" * 5000).nodes[0].markup()) == 5000 * 7


def test_foreign_paths(spark):
    rows = spark.createDataFrame([("https://site.test/a",), ("https://site.test",), ("https://site.testing/a",), ("https://o.test/a",), (None,)], "u string")
    assert [r[0] for r in rows.select(robots.path_of(F.col("u"), "https://site.test")).collect()] == ["/a", "", None, None, None]


def test_fetch_source(spark):
    rows = [("u", 404, None, None, False), ("u", 200, "text/html", None, False), ("v", 200, None, None, None), ("w", 200, "image/png", None, False), ("x", 200, "text/html", None, True)]
    fetched = tables.fetches(spark.createDataFrame(rows, tables.FETCHES))
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate("uvwxy")], tables.PAGES)
    assert fetched.count() == 4 and sorted(r["url"] for r in tables.parsed(pages, fetched).collect()) == ["u", "v"]


def test_outputs(spark, tmp_path):
    found = index.index(extract.located(extract.elements(spark.createDataFrame([(1, "https://site.test/", '<a href="/b"></a><a href="/a">')], tables.PAGES))), "link")
    outputs.write_json(found, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().asDict() == {"key": "https://site.test/", "values": ["/b", "/a"]}
    assert outputs.run_facts(spark, "link", 1.0, 3.456, True).first().asDict() == {"query": "link", "elapsed": "2.46", "incomplete": True}


def test_stream(spark, tmp_path):
    """Pages that arrive in files give the elements of the batch, and each new URL once."""
    rows = [(1, "https://site.test/", '<a href="/x">'), (2, "https://site.test/b", '<a href="/x"><a href="/y"><a href="https://o.test/">')]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], tables.PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    new = frontier.new_urls(frontier.page_stream(spark, str(tmp_path / "in"), 1), catalogue.TEST_SITE)
    query = new.writeStream.format("memory").queryName("new_urls").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(r["group_name"] for r in spark.table("new_urls").collect()) == ["https://site.test/x", "https://site.test/y"]

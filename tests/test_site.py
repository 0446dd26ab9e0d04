"""Stored label index, one record an element, pieces of indexes, deep crawls."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnweb import catalogue, catalogue_site
from tarnweb.operators import audit, closure, extract, index, label_index, labels, sets
from tarnweb.operators.label_index import LabelIndex
from tarnweb.plans.language import lex, run_query
from tarnweb.plans.options import AuditOptions, parse_flags
from tarnweb.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue_site.QUERIES))
def test_against_sql(spark, name):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
        want = db.sql(catalogue_site.SQL[name])
        columns = sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        rows = sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
    got = catalogue_site.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(tuple(map(str, r)) for r in got.select(*columns).collect()) == rows


def records(spark, n=700, seed=1):
    """Records of several pages with random labels; a third stand on one page."""
    rng = random.Random(seed)
    rows = [(rng.choice([0, rng.randrange(40)]), rng.choice(["link", "image", "iframe", "start"]), i, sum(1 << b for b in range(31) if rng.random() < (0.02 if b % 5 else 0.5))) for i in range(n)]
    return spark.createDataFrame(rows, "page_id bigint, kind string, node_pos int, bits bigint").repartition(3)


def random_query(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 3)):
        leaf = rng.choice(list(labels.PLACES)) if depth > 1 or rng.random() < 0.7 else f"({random_query(rng, depth + 1)})"
        parts.append(rng.choice(["", "", "!"]) + leaf)
    return "".join(p + (rng.choice([" & ", " | "]) if i < len(parts) - 1 else "") for i, p in enumerate(parts))


def test_label_index(spark, tmp_path):
    given = records(spark).cache()
    label_index.build(given, str(tmp_path / "i"), 5)
    found, rng = LabelIndex(spark, str(tmp_path / "i")), random.Random(3)
    same = lambda a, b: a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert found.counts == {r["label"]: r["n"] for r in given.select(F.explode(labels.label_names()).alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()} | {k: 0 for k, v in found.counts.items() if not v}
    for text in ["link", "internal", "!link", *[random_query(rng) for _ in range(8)]]:
        assert same(found.query(text), run_query(given, text, labels.PLACES, labels.flag)), text
        matches = found.matching(text)
        assert matches.agg(label_index.n_matching(F.col("hits")).alias("n")).first()["n"] == run_query(given, text, labels.PLACES, labels.flag).count()
    for text in (" link ", "a & nothing", "link &", "nothing"):
        assert found.query(text) is None and run_query(given, text, labels.PLACES, labels.flag) is None
    assert same(found.combine("link", "visited", "xor"), sets.combine(given, "link", "visited", "xor"))
    assert same(found.combine("link", "visited", lambda a, b: a.bitwiseAND(F.bitwise_not(b))), sets.combine(given, "link", "visited", "difference"))
    assert same(found.parity(["link", "internal", "visited"]), sets.parity(given, ["link", "internal", "visited"])) and same(found.complement("null"), sets.complement(given, "null"))


def test_label_index_reads_little(spark, tmp_path):
    """A query reads the bitmaps it names, with its rare label in the scan's filter, and only parts with matches."""
    given = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("link").alias("kind"), F.lit(0).alias("node_pos"), F.when(F.col("id") == 1500, 1 << labels.PLACES["notFound"]).otherwise(0).cast("long").alias("bits"))
    given = given.withColumn("bits", F.col("bits").bitwiseOR(F.lit(1 << labels.PLACES["link"]).cast("long")))
    label_index.build(given, str(tmp_path / "i"), 8)
    found = LabelIndex(spark, str(tmp_path / "i"))
    matches = found.matching("link & notFound")
    plan = matches._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PushedFilters") :]
    assert scan.index(label_index._column("notFound")) < scan.index(label_index._column("link")) and label_index._column("visited") not in plan
    assert [r["page_id"] for r in found.fetch(matches).collect()] == [1500]
    assert matches.select("part").distinct().count() == 1
    empty = str(tmp_path / "empty")
    label_index.build(given.limit(0), empty, 2)
    assert LabelIndex(spark, empty).query("link").count() == 0


def test_needed_labels():
    for text, want in (("a & b", {"a", "b"}), ("a | b", set()), ("!(!a | b)", {"a"}), ("(a | a & b) & c", {"a", "c"}), ("!a", set()), ("!(!a & !a)", {"a"})):
        assert label_index.needed_labels(lex(text).tokens) == want


def test_selection(spark):
    html = '<a href="/x#one">1</a><p class=s>p</p><a class=s href="/x#two">2</a><img class=s src="/i.png#z"><img src="/j.png"><div class=s href="/no">d</div><a class=s>bare</a><script class=s src="/s.js"></script><!-- <a class=s> -->'
    pages = spark.createDataFrame([(1, "https://site.test/a", html), (2, "https://site.test/b", None)], tables.PAGES)
    options = parse_flags("-CSS-Selector'.s'")
    found = audit.records(pages, catalogue.TEST_SITE, options)
    got = {(r["kind"], r["node_pos"]): (r["group_name"], r["names"]) for r in found.withColumn("names", F.array_sort(labels.label_names())).collect()}
    assert len(got) == 9
    assert got["link", 0] == ("https://site.test/x", ["anchor", "internal", "link"])
    assert got["link", 1] == ("https://site.test/x#two", ["anchor", "internal", "link", "userSelected"])
    assert got["link", 2] == ("", ["link", "null", "userSelected"])
    assert got["image", 0] == ("https://site.test/i.png#z", ["image", "internal", "noAltText", "userSelected"]) and "userSelected" not in got["image", 1][1]
    assert sorted((g, n) for (k, _), (g, n) in got.items() if k == "selected") == [("DIV", ["userSelected"]), ("P", ["userSelected"]), ("https://site.test/s.js", ["userSelected"])]
    assert got["start", 0] == ("https://site.test/", ["startPage", "visited"])
    values = index.index(run_query(found, "userSelected | link", labels.PLACES, labels.flag).where("page_id = 1"), "userSelected | link").first()["values"]
    assert values == ["/i.png#z", '<p class="s">p</p>', "/x#two", "/no", '<a class="s">bare</a>', "/s.js", "/x#one"]
    plain = audit.records(pages, catalogue.TEST_SITE, AuditOptions())
    assert plain.count() == 6 and run_query(plain, "userSelected", labels.PLACES, labels.flag).isEmpty()


def test_selected_crawl(spark):
    """A selected link with a fragment is its own group, and its page is followed."""
    rows = [(1, "https://site.test/", '<a class=s href="/a#x">'), (2, "https://site.test/a", '<a href="/b">')]
    flagged = audit.flagged(spark.createDataFrame(rows, tables.PAGES), catalogue.TEST_SITE, parse_flags("-select'.s'"))
    rules = spark.createDataFrame([("https://site.test", [], [])], "origin string, allow array<string>, disallow array<string>")
    got = {r["group_name"]: r["depth"] for r in closure.crawl(flagged, rules, catalogue.TEST_SITE).collect()}
    assert got == {"https://site.test/": 0, "https://site.test/a": 1, "https://site.test/a#x": 1, "https://site.test/b": 2}


@pytest.mark.parametrize("size", [1, 9, 10_000])
def test_pieces(spark, size):
    rng = random.Random(size)
    rows = [(p, "https://site.test/%d" % p, "link", i, "https://h.test/" if rng.random() < 0.6 else rng.choice(["https://h.test/a", "https://h.test/b#x", ""])) for p in range(60) for i in range(rng.randint(0, 12))]
    found = spark.createDataFrame(rows, "page_id bigint, document string, kind string, node_pos int, url_prop string").withColumn("markup", F.lit("<a>")).withColumn("url_attr", F.col("url_prop"))
    for inverted in (False, True):
        whole = {r["key"]: r["values"] for r in index.index(found, "(link)", inverted).collect()}
        got, joined = index.pieces(found, "(link)", inverted, size).orderBy("key", "piece").collect(), {}
        for r in got:
            assert 1 <= len(r["values"]) <= size and r["piece"] * size == len(joined.setdefault(r["key"], []))
            joined[r["key"]] += r["values"]
        assert joined == whole
    assert index.pieces(found.limit(0), "link").count() == 0


def search(edges, seeds):
    depth, now = {s: 0 for s in seeds}, list(seeds)
    to = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
    while now:
        new = []
        for a in now:
            for b in to.get(a, ()):
                if b is not None and b not in depth:
                    depth[b] = depth[a] + 1
                    new.append(b)
        now = new
    return depth


@pytest.mark.parametrize("kind", ["random", "ways", "circles"])
def test_closure_shapes(spark, monkeypatch, kind):
    monkeypatch.setattr(closure, "ROUNDS", 1)
    rng = random.Random(kind)
    if kind == "random":
        edges = [(rng.randrange(80), rng.choice([None, *range(80)])) for _ in range(110)]
    elif kind == "ways":  # long ways that part, meet again and lead back
        edges = [(i, i + 1) for i in range(120) if i % 50 != 49] + [(rng.randrange(120), rng.randrange(120)) for _ in range(12)] + [(3, 50), (45, 100), (7, 7)]
    else:  # two circles that nothing leads into, one that is reached
        edges = [(0, 1), (1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 10), (12, 13), (13, 14), (20, 20), (20, 21), (3, 30)]
    frame = spark.createDataFrame(edges, "src int, dst int").coalesce(2)
    want = search(edges, [0])
    assert {r["node"]: r["depth"] for r in closure.closure(frame, spark.createDataFrame([(0,), (None,)], "node int")).collect()} == want
    assert {r["node"]: r["depth"] for r in closure.closure(frame, spark.createDataFrame([(0,)], "node int"), 5).collect()} == {k: v for k, v in want.items() if v <= 5}


def test_long_chain(spark, monkeypatch):
    """A chain of ten thousand pages takes few rounds."""
    rounds, write = [], closure.stored
    monkeypatch.setattr(closure, "stored", lambda df, label="": rounds.append(label) or write(df, label))
    n = 10_000
    edges = spark.range(n).selectExpr("id AS src", "id + 1 AS dst").unionByName(spark.createDataFrame([(n, 0), (5, 5000), (n, n + 1)], "src long, dst long")).coalesce(2)
    got = closure.closure(edges, spark.createDataFrame([(0,)], "node long"))
    assert len(rounds) < 40
    row = got.agg(F.count("*").alias("n"), F.max("depth").alias("deep"), F.sum("depth").alias("sum")).first()
    want = [min(i, 6 + i - 5000) if i >= 5000 else i for i in range(n + 2)]
    assert (row["n"], row["deep"], row["sum"]) == (n + 2, max(want), sum(want))


def test_deadline(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    timer = closure.Timer(0.0)
    got = closure.closure(edges, spark.createDataFrame([(0,)], "node int"), timer=timer)
    assert timer.expired and [r["node"] for r in got.collect()] == [0]
    assert parse_flags("-ignoreTimeout", timeout=5.0).deadline is None and parse_flags("", timeout=5.0).deadline == 5.0


def test_flag_texts():
    assert parse_flags("-disallow '/a'").disallow == () and parse_flags("-disallow'/a\n/b'").disallow == ()
    assert parse_flags("-disallow'/a' x'").disallow == ("/a' x",) and parse_flags("-disallow`/a , /b`").disallow == ("/a", "/b")
    assert parse_flags("-select`a` -select`b`").selector == "a"

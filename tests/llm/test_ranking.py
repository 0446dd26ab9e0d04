"""Ranked search against scoring of every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tarnweb.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(docs, items, k=10):
    lists = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    lists = [(d, Counter(t), len(t)) for d, t in lists if t]
    N, L = len(lists), sum(n for *_, n in lists)
    df = Counter(t for _, c, _ in lists for t in c)
    w = {t: math.floor(1000 * math.log((2.0 * N + 2) / (2.0 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in sorted(set(items), key=str):
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for d, c, n in lists:
            m = 25 + 75 * n * N // L
            s = sum(times * w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(n=900):
    rng = random.Random(8)
    words = [w for i in range(300) for w in ["".join(rng.choice("abcdeéñ09") for _ in range(rng.randint(1, 6)))] * (1 + 300 // (i + 1))]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "_", "'", "\n", "́ "]) for _ in range(n))
    docs = [(i * 3, text(rng.choice([0, 1, 5, 40, 200]))) for i in range(n)]
    docs += [(5000 + i, docs[4][1]) for i in range(40)] + [(6000, None), (6001, ""), (6002, " .,- "), (6003, "abc " * 20_000), (None, docs[9][1]), (None, "e"), (12, docs[9][1]), (12, docs[9][1])]
    items = [(i, text(rng.choice([1, 3, 20, 60]))) for i in range(25)] + [(100, docs[4][1]), (101, None), (102, ""), (103, "zzzzzz nowhere"), (104, "E é E"), (104, "another text of the id d"), (0, "abc abc"), (105, docs[9][1]), (105, docs[9][1])]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' AS term", "1 AS shard", "2L AS n").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string").selectExpr("item_id", "text", "7 AS rank"),
    )


def small_shards(monkeypatch):
    monkeypatch.setattr(ranking, "SHARD_DOCS", 150)
    run = ranking._shards
    monkeypatch.setattr(ranking, "_shards", lambda batches: run(b.slice(i, 70) for b in batches for i in range(0, len(b), 70)))


@pytest.mark.parametrize("kind", ["plain", "portions"])
def test_ranked(spark, monkeypatch, kind):
    docs, items = rows()
    if kind == "portions":
        small_shards(monkeypatch)
        monkeypatch.setattr(ranking, "ITEMS", 9)
        monkeypatch.setattr(ranking, "VOCABULARY", 5)
    got = ranking.ranked(*frames(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plainly(docs, items)


def test_sql(spark, tmp_path):
    docs, items = rows(200)
    docs, items = [r for r in docs if r[0] not in (None, 12)], [r for r in items if r[0] != 104]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        want = db.execute(ranking.SQL).fetchall()
    assert sorted(map(tuple, ranking.query(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str) == plainly(docs, items)


def test_empty(spark):
    docs, items = frames(spark, *rows(30))
    assert ranking.ranked(docs.limit(0), items).collect() == []
    assert ranking.ranked(docs, items.limit(0)).collect() == []


def test_blocks():
    """The cheapest cut of all, by trying every way over the allowed lengths."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 20, 60):
        for _ in range(20):
            impact = rng.integers(1, 50, n) ** 2
            price = ranking.BLOCK_COST * (impact.mean() if n else 0)
            total = [0.0] * (n + 1)
            for i in range(1, n + 1):
                total[i] = min(total[i - x] + price + x * impact[i - x : i].max() for x in ranking.LENGTHS if x <= i)
            ends = ranking.block_ends(impact)
            spent = sum(price + (b - a) * impact[a:b].max() for a, b in zip([0, *ends], ends))
            assert (not n and not len(ends)) or (ends[-1] == n and spent == pytest.approx(total[n]))


def test_skipping():
    """A rare, heavy term makes whole blocks of a frequent one go unread."""
    places = np.arange(20_000)
    impact = np.where(places < 15, 9, 1)
    ends = ranking.block_ends(impact)
    heavy = np.array([3, 9, *range(30, 40), 4000, 17_000])
    asked, read = {"common": 1, "rare": 1000}, []

    class Spy(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype.kind == "i":
                read.append(len(at))
            return super().__getitem__(at)

    lists = ranking.Lists.__new__(ranking.Lists)
    lists.doc_ids = places
    lists.of = {
        "common": (places.view(Spy), impact, ends, np.maximum.reduceat(impact, np.concatenate([[0], ends[:-1]]))),
        "rare": (heavy, np.ones(len(heavy), np.int64), np.arange(1, len(heavy) + 1), np.ones(len(heavy), np.int64)),
    }
    found, scores = ranking.best(lists, asked)
    want = sorted(((-(1000 * (p in heavy) + int(impact[p])), p) for p in range(20_000)))[:10]
    assert list(zip((-scores).tolist(), found.tolist())) == want
    assert sum(read) < 20_000

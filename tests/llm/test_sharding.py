"""Shards against a plain minimax partition."""

import collections
import random
import zlib

import pytest

from tarnweb.llm import sharding


def least_capacity(sizes, shards):
    """The least capacity, by trying sums of stretches (small inputs)."""
    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    low, high = max([0, *sizes]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def plainly(sizes, shards):
    """(groups alone, capacity of the rest) of sizes by key."""
    alone, rest = [], dict(sizes)
    while rest and len(alone) < shards - 1:
        key = min(rest, key=lambda k: (-rest[k], k))
        if rest[key] <= sum(rest.values()) / (shards - len(alone)):
            break
        alone.append(key)
        del rest[key]
    return alone, least_capacity([rest[k] for k in sorted(rest)], shards - len(alone))


@pytest.mark.parametrize("bits,level", [(2, 16), (12, 1 << 15)])
def test_plan(spark, monkeypatch, bits, level):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "LEVEL", level)
    rng = random.Random(5)
    for n, hot in ((0, 0), (1, 0), (5, 1), (300, 0), (400, 2)):
        sizes = {rng.randrange(-(2**63), 2**63): rng.choice([8, 20, 300, rng.randint(8, 4000)]) for _ in range(n)}
        for k in list(sizes)[:hot]:
            sizes[k] = 200_000
        rows = [(k, s) for k, s in sizes.items()] + [(k, 50) for k in list(sizes)[:3]]
        for k in list(sizes)[:3]:
            sizes[k] += 50
        got = sharding.plan(spark.createDataFrame(rows, "key bigint, size bigint").cache(), 7)
        alone, capacity = plainly(sizes, 7)
        assert list(got.alone) == alone
        rest = {k: s for k, s in sizes.items() if k not in alone}
        assert got.capacity == (capacity if rest else 0)
        taken = collections.Counter()
        for k, s in rest.items():
            taken[sum(k > c for c in got.last)] += s
        assert len(got.last) <= 6 - len(alone) and max([0, *taken.values()]) <= got.capacity


def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 150))) for _ in range(500)]
    out = list(enumerate(made)) + [(1000 + i, made[7] * 3) for i in range(300)] + [(2000, None), (2001, None), (2002, ""), (None, "no id"), (None, "no id"), (None, None)]
    return out + [(3000, "one row many times")] * 9000 + [(3001, "long " * 40_000)]


def test_assign(spark):
    given = rows()
    docs = spark.createDataFrame(given, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS shard", "2 AS key", "3 AS n").repartition(5)
    got = sharding.assign(docs).collect()
    key = lambda d, s, c: (d is not None, d or 0, s, c)
    want = collections.Counter(key(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in given)
    assert collections.Counter(key(r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, of, size = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of[r["key"]].add(r["shard"])
        size[r["key"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert all(len(s) == 1 for s in of.values())
    assert len(size) == len({t for _, t in given})
    alone, capacity = plainly(size, 24)
    taken = collections.Counter()
    for k, s in size.items():
        taken[min(of[k])] += s
    assert [min(of[k]) for k in alone] == list(range(len(alone))) and len(alone) >= 2
    assert max(s for k, s in taken.items() if k >= len(alone)) == capacity
    again = sharding.assign(docs.repartition(2)).collect()
    assert collections.Counter(again) == collections.Counter(got)


def test_write(spark, tmp_path):
    docs = spark.createDataFrame(rows()[:900], "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS shard", "'x' AS source")
    sharding.write(docs, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == {"doc_id", "text", "shard", "source"}
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).isEmpty() and back.count() == docs.count()
    assert back.where("text is not null").groupBy("text").agg({"shard": "approx_count_distinct"}).where("`approx_count_distinct(shard)` > 1").isEmpty()


def test_empty(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []

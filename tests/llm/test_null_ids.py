"""Rows without an id among near copies."""

import random

from tarnweb.llm import forest


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_rows_without_ids(spark):
    rng = random.Random(11)
    a, b, c, d = (words(rng, 80) for _ in range(4))
    made = [(1, a), (None, a), (None, a + " tail"), (2, a + " end"), (None, b), (None, b), (None, b + " more"), (None, c), (None, d), (None, d), (5, None), (None, None), (None, ""), (None, "few words")]
    got = [(r["doc_id"], r["text"]) for r in forest.one_of_each(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()]
    assert (1, a) in got and got.count((None, c)) == 1 and got.count((None, d)) == 1
    assert len([t for i, t in got if t and t.startswith(a)]) == 1 and len([t for i, t in got if t and t.startswith(b)]) == 1
    assert [x in got for x in ((5, None), (None, None), (None, ""), (None, "few words"))] == [True] * 4 and len(got) == 8
    again = forest.one_of_each(spark.createDataFrame(list(reversed(made)), "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(str((r["doc_id"], r["text"])) for r in again)

"""Indented JSON written by executors, and previews, against the text made in one place."""

import random

import pytest
from pyspark.sql import functions as F

from tarnweb.operators import index
from tarnweb.sources import outputs


def matching(spark, n, keys, seed=1):
    rng = random.Random(seed)
    values = ["/a", "", None, 'quo"te\\', "tab\tline\n", "\x1f\x0b\\u000B\\", "é   \U0001f600", "/" + "long" * 300]
    rows = [(p, rng.choice(keys), "link", i, rng.choice(values)) for p in range(n) for i in range(rng.randint(1, 4))]
    return spark.createDataFrame(rows, "page_id bigint, document string, kind string, node_pos int, url_attr string").withColumn("markup", F.lit("<a>")).withColumn("url_prop", F.lit(""))


@pytest.mark.parametrize("n, keys", [(0, ["x"]), (1, ["x"]), (60, ["b", "a", "10", "9", "007", "4294967295", "4294967294", 'k"\n', "\x1e"]), (400, [f"https://site.test/{i}" for i in range(90)])])
def test_written(spark, tmp_path, n, keys):
    found = matching(spark, n, keys)
    want = outputs.pretty(index.index(found, "link"))
    pieces = index.pieces(found, "link", size=3)
    outputs.write_pretty(pieces, str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text(newline="") for p in parts) == want + "\n"
    for limit in (5000, 40, 300):
        assert outputs.previewed(pieces, limit) == outputs.preview(want, limit)
    assert outputs.previewed(pieces) == outputs.shown(index.index(found, "link"))

"""Fill-in-the-middle against a plain version."""

import hashlib
import random
import re

import pytest

from tarnweb.llm import infill


def plainly(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(b"1:" + str(doc_id if doc_id is not None else "null").encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(2)
    odd = ["a", "é", "<P", "x<P>y", "<S", "<<S<M", "S><M", "one\ntwo\r\n\tthree", "a1b2 c3", "\U0001f600 face é́", "İstanbul", "word " * 30_000, "ab" * 40_000, "<" * 500, "\x00\x1f", "  "]
    made = ["".join(rng.choice("ab <>PSM é1\n") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out = list(enumerate(odd + made)) + [(i, odd[11]) for i in range(500, 560)]
    return out + [(None, None), (None, "no id at all"), (7, None), (7, "same id"), (7, "same id"), (-5, "negative id"), (2**62 + 1, "large id"), (9, "")]


def test_infill(spark):
    given = rows()
    docs = spark.createDataFrame(given, "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' AS form", "1 AS _made2", "2 AS extra").repartition(3)
    got = infill.transformed(docs)
    assert got.columns == ["doc_id", "text", "_made2", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    out = got.collect()
    assert sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out], key=key) == sorted([plainly(*x) for x in given], key=key)
    assert all(infill.rebuilt(r["output"], r["form"]) == (r["text"] or "") for r in out)
    assert all(r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_query(spark, tmp_path):
    given = rows()
    spark.createDataFrame([(*x, "en", "s", 1) for x in given], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted(str((*plainly(*x)[:5], sha(plainly(*x)[5]), sha(x[1]))) for x in given)
    got = infill.query(spark, str(tmp_path))
    assert dict(got.dtypes)["prefix_chars"] == "bigint"
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert infill.transformed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_refused():
    for output, form in (("text", "psm"), ("<P>a<S>b", "psm"), ("<P>a<S>b<M>c", "spm")):
        with pytest.raises(ValueError):
            infill.rebuilt(output, form)

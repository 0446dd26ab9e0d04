"""Hashes that collide must not cost a byte."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tarnweb.llm import suffixes


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def without_repeats(raw):
    seen = collections.Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    out = {}
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\x01" * 400
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[hashlib.sha256(b).digest()[:16]] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), kept)
    return out


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_colliding_hashes(spark, bits):
    """With a hash of few bits nearly all unions, cores and strings collide; the result stays that of brute force."""
    rng = random.Random(3)
    block, other = words(rng, 130), words(rng, 100)
    made = [words(rng, 60) + block[i : 620 + i] + words(rng, 40) for i in range(0, 12, 3)] + [words(rng, 50) + other + words(rng, rng.randint(0, 90)) for _ in range(5)] + [words(rng, 300) for _ in range(12)] + ["ab" * 500, "ab" * 450 + "c", "", "x"]
    docs = spark.createDataFrame([(t,) for t in made], "text string").repartition(3)
    got = {bytes(r["digest"]): (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.repeated(docs, bits=bits).collect()}
    assert got == without_repeats([t.encode() for t in made])


def test_checks():
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 3, 9000).astype(np.uint8)
    raw[5000:5600] = raw[100:700]
    prefix = suffixes.prefix_checks(raw)
    at = np.arange(8000)
    got = suffixes.span_check(prefix, at, at + 400)
    for i in (0, 1, 77, 5000, 7999):
        assert int(got[i]) == sum((int(c) + 1) * pow(suffixes.CHECK_BASE, k, suffixes.PRIME) for k, c in enumerate(raw[i : i + 400])) % suffixes.PRIME
    assert (got[100:300] == got[5000:5200]).all() and len(np.unique(got)) == 8000 - 201

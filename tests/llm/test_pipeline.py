"""The corpus pipeline against plain Python, stage by stage, on whole tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np

import corpus_pipeline
from tarnweb.llm import quality, token_files

SF = "/root/testdata/sf0.001"


def near_copies(docs):
    """The least doc_id of each group of texts linked at 0.8 on five words."""
    sets = {}
    for d, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    group = {d: d for d, _, _ in docs}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            lo, hi = sorted((top(a), top(b)))
            group[hi] = lo
    return [r for r in docs if top(r[0]) == r[0]]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def clean(docs, items):
    windows = collections.defaultdict(set)
    for q in map(words, items):
        n = min(13, len(q))
        windows[n] |= {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if q else set()
    kept = []
    for row in docs:
        w = words(row[1])
        hit = {i + j for n, own in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own for j in range(n)}
        if not hit or 20 * len(hit) < len(w):
            kept.append(row)
    return kept


def mixed(docs):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _ in docs}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    queue = []
    for s in sources:
        own = sorted((int(hashlib.md5(f"tarn:{d}".encode()).hexdigest()[:15], 16), d, size[d]) for d, _, x in docs if x == s)
        whole = sum(n for *_, n in own)
        for p in range(2):
            upto = whole * p
            for key, d, n in own:
                upto += n
                queue.append((upto / weight[s], key, d, n))
    run, budget, out = 0, int(sum(size.values()) * 1.5), []
    for _, _, d, n in sorted(queue):
        run += n
        if run > budget:
            break
        out.append(d)
    return out


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    frame = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = [(r["doc_id"], r["text"] or "", r["source"]) for r in frame["documents"].collect()]
    model = quality.fit(frame["documents"], frame["labels"])
    z = quality._scaled(np.array([quality.features(t) for _, t, _ in docs]), model["centre"], model["scale"]) @ model["weights"]
    good = [r for r, s in zip(docs, quality._sigmoid(z)) if s >= quality.THRESHOLD]
    apart = near_copies(good)
    left = clean(apart, [r["text"] for r in frame["benchmark"].collect()])
    assert len(docs) > len(good) > len(apart) > len(left) > 0
    text = {d: t for d, t, _ in left}
    tokens = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    want, start = [], 0
    for d in sorted(mixed(left)):
        ids = [*tokens.encode(text[d], add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want

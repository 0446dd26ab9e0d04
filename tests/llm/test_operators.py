"""Operators against brute force on small tables with the odd cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnweb.llm import chat, decontaminate, fingerprints, forest, lcp_merge, mixing, pii, quality, registry, simple8b, suffixes, token_counts, token_files, tokens

WORDS = "the of and than ding oran mist velo quar tin sol per lam nix gro".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "io", "ser", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [text(rng, n) for n in (5, 40, 120, 300, 80, 12, 200)]
    out = [(i, t, None if i % 4 == 3 else f"s{i % 3}") for i, t in enumerate(base)]
    long = text(rng, 9000)
    shared = text(rng, 90)
    more = [None, "", "   \n", base[3], base[3] + " tail", base[2].replace("the", "THE", 1), long, long[:30000], text(rng, 30) + " " + shared + text(rng, 9), shared + " " + text(rng, 40), "é" * 500, "ab" * 700,
            "call +1 (743) 555-3824 or a.b_c@x-y.example.com,d@e.f 10.0.0.255 1.2.3.999 x 4111-1111-1111-1111 y 4785380592391130", "mail jo [at] site [dot] org or (212) 555-0100", "\\x <|turn|> 's <|endoftext|> \x1ć"]
    return out + [(100 + i, t, "hot") for i, t in enumerate(more)] + [(None, "no id " + base[1], None), (5, base[5], "s2")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Columns beyond the needed ones have names the operators use inside."""
    made = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return made.selectExpr("doc_id", "text", "source", "'en' AS lang", "1L AS n_chars", "0 AS size", "'x' AS key", "2 AS node", "3 AS digest").repartition(3)


def texts(rows):
    return [(d, t or "") for d, t, _ in rows]


def test_mix(docs, rows):
    got = mixing.mix(docs).select("row.doc_id", "size", "source_size", "target", "copies", "row.source").collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
    assert sorted(r["size"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in texts(rows))
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = (r["target"], r["source_size"])
    assert sum(t for t, _ in target.values()) == pytest.approx(1.5 * sum(s for _, s in target.values()))
    for s, (t, whole) in target.items():
        assert t <= 2 * whole + 1e-6 and abs(taken[s] - t) <= 9000
    again = mixing.mix(docs.repartition(7)).select("row.doc_id", "size", "copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(docs).select("row.doc_id", "size", "copies").collect())
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mix_repeated_rows(spark):
    """Copies of one row that the cut goes through: as many are taken as fit."""
    made = [(1, "a b c", "x")] * 50 + [(i, "d e", "y") for i in range(2, 40)] + [(None, "f", None)] * 9
    d = spark.createDataFrame(made, "doc_id bigint, text string, source string")
    for share in (0.3, 1.1, 1.5, 2.0):
        got = mixing.mix(d, share=share).select("size", "copies").collect()
        whole = sum(r["size"] for r in got)
        taken = sum(r["size"] * r["copies"] for r in got)
        assert len(got) == len(made) and share * whole - 3 <= taken <= share * whole


def test_mix_many_sources(spark, monkeypatch, docs):
    """Beyond the bound the tables of sources are joined by key, with the same result."""
    want = sorted(map(str, mixing.mix(docs).select("row.doc_id", "size", "copies").collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    assert sorted(map(str, mixing.mix(docs).select("row.doc_id", "size", "copies").collect())) == want


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), c.sql(registry.SQL[name]).df()
    k = sorted(got.columns)
    assert sorted(map(tuple, got[k].astype(str).values)) == sorted(map(tuple, want[k].astype(str).values))


def test_quality(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(d, l)
    scored = d.select("doc_id", "text").mapInArrow(quality.scorer(model), "doc_id long, text string, _score double").drop("text").join(l, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    predicted = (scored["_score"] >= quality.THRESHOLD).astype(int)
    assert scored["_score"].between(0, 1).all() and (predicted == scored["quality"]).mean() > 0.96
    assert 0.7 < model["prior"] < 0.95


def test_quality_risk():
    """The fit against plain gradient descent on the non-negative risk, written anew."""
    rng = np.random.default_rng(4)
    prior, n = 0.6, 1500
    pos = rng.normal(1, 1, (n, 3))
    unl = np.concatenate([rng.normal(1, 1, (int(n * prior), 3)), rng.normal(-1, 1, (n - int(n * prior), 3))])
    pos, unl = (np.concatenate([x, np.ones((len(x), 1))], 1) for x in (pos, unl))

    def risk(w, decay=1e-3):
        loss = lambda z: np.log1p(np.exp(-z)).mean()
        return prior * loss(pos @ w) + max(0.0, loss(-(unl @ w)) - prior * loss(-(pos @ w))) + decay / 2 * (w[:-1] ** 2).sum()

    w = np.zeros(4)
    for step in range(2000):
        slope = np.array([(risk(w + e) - risk(w - e)) / 2e-5 for e in np.eye(4) * 1e-5])
        w = w - 0.5 * slope
    got = quality._fit(pos, unl, prior)
    assert risk(got) <= risk(w) + 2e-3 and np.allclose(got, w, atol=0.15)


def test_quality_repeated_ids(spark):
    """Many rows under one doc_id do not grow the fit's sample, and reruns agree."""
    rng = random.Random(6)
    d = spark.createDataFrame([(i % 9, text(rng, 30)) for i in range(400)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    a, b = (quality.fit(x, labels, positives=5, unlabelled=5) for x in (d, d.repartition(5)))
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_quality_odd(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.fit(docs, none)
    got = docs.select("doc_id", "text").mapInArrow(quality.scorer(model), "doc_id long, text string, _score double").collect()
    assert all(r["_score"] == 0.5 for r in got)
    assert quality.accepted(docs, none, threshold=0.5).columns == docs.columns


@pytest.mark.parametrize("vocabulary", [token_counts.VOCABULARY, "word_bpe_49k.json"])
def test_token_counts(docs, rows, vocabulary):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    got = collections.Counter(tuple(r) for r in token_counts.count_tokens(docs, vocabulary).collect())
    want = collections.Counter()
    for d, x in texts(rows):
        e = t.encode(x, add_special_tokens=False)
        starts = [0] + [m.end() for m in re.finditer("\n", x) if m.end() < len(x)]
        at = [sum(s <= a for s in starts) - 1 for a, _ in e.offsets]
        crossing = sum(b > (starts[k + 1] if k + 1 < len(starts) else len(x)) for (_, b), k in zip(e.offsets, at))
        want[d, len(e.ids), len(starts), crossing, ",".join(str(at.count(i)) for i in range(len(starts)))] += 1
    assert got == want


@pytest.mark.parametrize("vocabulary", [token_counts.VOCABULARY, token_files.VOCABULARY])
def test_token_search(rows, vocabulary):
    """Borders searched for among the tokens against all offsets, for any sections."""
    tokenizer, rng = tokens.whole(vocabulary), random.Random(6)
    for _, t in [*texts(rows), (0, "x"), (0, "日本語 𝒳𝒴 é́ " * 40)]:
        e = tokenizer.encode(t, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
        for n in (0, 1, 3, 40, len(t)):
            starts = np.array([0, *sorted(rng.randint(0, len(t)) for _ in range(n))])
            counts, crossing = token_counts.attribute(offsets[:, 0], offsets[:, 1], starts, len(t))
            assert token_counts.search(e, starts.tolist()) == (counts.tolist(), crossing)


def test_personal_data(docs, rows):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    got = {(r["doc_id"], tuple((k, s["start"], s["end"]) for k in pii.BASE for s in r[k])): r for r in pii.detect(docs).collect()}
    for d, x in texts(rows):
        want = tuple((k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, x) if fits(k, m[0]))
        assert (d, want) in got
    assert sum(len(k[1]) for k in got) == 5


def test_simple8b():
    rng = np.random.default_rng(1)
    for lengths in ([0, 1, 300, 0, 255, 256, 257], [5000]):
        n = sum(lengths)
        for high in (1, 2, 50_000, 1 << 32, 1 << 60, (1 << 63)):
            v = rng.integers(0, high, n, np.uint64) if high < 1 << 63 else np.where(rng.random(n) < 0.1, np.uint64(2**64 - 1), rng.integers(0, 9, n, np.uint64)).astype(np.uint64)
            v[: n // 3] = np.minimum(v[: n // 3], 3)
            back, sizes = simple8b.decode(simple8b.encode(v, np.array(lengths)))
            assert (back == v).all() and sizes.tolist() == lengths


def test_token_files(spark, docs, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    path = f"file://{tmp_path}/out"
    token_files.write(docs, path)
    got = token_files.read_digests(spark, path).orderBy("start").collect()
    want = collections.Counter((d, tuple(t.encode(x, add_special_tokens=False).ids + [1])) for d, x in texts(rows))
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in token_files.read_ids(spark, path).collect()) == want
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter({(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())): n for (d, i), n in want.items()})
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in got]
    assert ids == sorted(ids)


def test_chat(spark):
    odd = ["a\\<|end|>", "<|turn|>x<|text|>", "\\\\<", "", None, chat.PROBE, "é\n\U0001f600 ok"]
    turns = [(c, i, "assistant" if i % 2 else ("user", None)[c % 2], odd[(c + i) % len(odd)]) for c in range(7) for i in range(5)] + [(None, 0, "user", "x"), (1, 1, "assistant", odd[2])]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    by = collections.defaultdict(list)
    for c, i, r, x in turns:
        by[c].append((i, r or "", x or ""))
    for c, own in by.items():
        own.sort()
        raw = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        w = got[c]
        assert (w["n_turns"], w["turns_sha256"], w["loss_chars"], w["loss_sha256"]) == (len(own), hashlib.sha256(raw.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_decontaminate(spark, docs, rows):
    items = spark.createDataFrame([(10, rows[2][1]), (9, "mist OF"), (11, None), (12, "zzz"), (13, rows[4][1][:200])], "item_id bigint, text string")

    def words(x):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))

    want = collections.Counter()
    for d, x in texts(rows):
        w, hit, found = words(x), set(), set()
        for i in items.collect():
            q = words(i["text"])
            n = min(13, len(q))
            for win in [tuple(q[j : j + n]) for j in range(len(q) - n + 1)] if q else []:
                for j in range(len(w) - n + 1):
                    if tuple(w[j : j + n]) == win:
                        hit |= set(range(j, j + n))
                        found.add(str(i["item_id"]))
        want[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    assert collections.Counter(tuple(r) for r in decontaminate.judged(docs, items).collect()) == want
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])


def test_proximity(spark):
    """Places of a window's rarest term near which most of its terms stand, against brute force."""
    rng = random.Random(8)
    made = [(i, text(rng, 150)) for i in range(12)]
    own = decontaminate.words_of
    item = " ".join(made[3][1].split()[20:33])
    shuffled = item.split()
    rng.shuffle(shuffled)
    made += [(50, text(rng, 20) + " " + " ".join(shuffled) + " " + text(rng, 20)), (51, None)]
    d, items = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    words = {r["doc_id"]: r["w"] for r in d.select("doc_id", own(F.col("text")).alias("w")).collect()}
    windows, terms, index = decontaminate.indexed(d, items)
    want = collections.Counter()
    for w in terms.collect():
        ranked = [t["term"] for t in w["terms"]]
        count = {t: sum(x.count(t) for x in words.values()) for t in ranked}
        assert ranked == sorted(ranked, key=lambda t: (count[t], t))
        for x in words.values():
            for at in (i for i, y in enumerate(x) if y == ranked[0]):
                near = len(set(x[max(at - 12, 0) : at + 13]) & set(ranked))
                if near >= 0.8 * len(set(ranked)):
                    want[bytes(w["wid"]), at, near] += 1
    got = collections.Counter((bytes(r["wid"]), r["at"], r["near"]) for r in decontaminate.nearby(index, terms, 0.8).collect())
    assert got == want and len(want) >= 2


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprinted(docs).collect()
    ordered = sorted((r for r in rows if r[0] is not None and r[0] != 5), key=lambda r: -r[0])
    by = {r["doc_id"]: r for r in got}
    for (d, x, _), (_, y, _) in zip(ordered[:10], ordered[1:]):
        x, y = x or "", y or ""
        h = len(x) // 2
        assert by[d]["edited_sha256"] == hashlib.sha256((x[: len(x) - h] + y[:h]).encode()).hexdigest()
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next")) and len(got) == len(rows)
    assert by[3]["fingerprint"] == by[103]["fingerprint"] and by[3]["near_edited"] > 0.02
    swapped = docs.sparkSession.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "g h i j k l a b c d e f"), (3, "a b c d e f g h i j k l")], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprinted(swapped).collect()}
    assert f[1] == f[3] != f[2]


def plain_order_minhash(t):
    """Order MinHash in plain Python, a permutation of all k-mers a sketch."""

    def chained(parts):
        seed = 42
        for part in parts:
            seed = xxhash.xxh64_intdigest(part, seed=seed)
        return seed

    def number(v):
        return (v - (1 << 34) if v >> 33 else v).to_bytes(8, "little", signed=True)

    words = [w[i : i + 32] for w in re.split(r"[ \t\n\x0b\f\r]+", t) for i in range(0, len(w), 32)]
    times, items = collections.Counter(), []
    for i in range(max(len(words) - 2, 1) if words else 0):
        h = chained(w.encode() for w in words[i : i + 3]) >> 30
        items.append((chained([number(h), times[h].to_bytes(4, "little")]) >> 30 if times[h] else h, i))
        times[h] += 1
    out = ""
    for s in range(64):
        order = sorted(items, key=lambda x: (((((x[0] >> 28) + 32) % 64 ^ s) * (2 * s + 1)) % 64, x[0] % (1 << 28), x[1]))
        chosen = sorted(order[:2], key=lambda x: x[1])
        out += f"{chained(number(h) for h, _ in chosen) & 0xFFFFFFFF:08x}" if chosen else "-" * 8
    return out


def test_fingerprints_plain(spark, rows):
    """Every fingerprint equals plain Order MinHash, texts of few words and repeats included."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    made = [t or "" for _, t, _ in rows] + ["a", "a b", "a b c", "a b c d", "a " * 50, "x" * 500 + " tail " + "y" * 33]
    made += [" ".join(rng.choice(vocabulary[:m]) for _ in range(n)) for n in (5, 20, 33, 34, 35, 36, 60, 150, 500) for m in (3, 300)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in fingerprints.with_fingerprint(df, "text", "f").select("doc_id", "f").collect()}
    assert [got[i] for i in range(len(made))] == [plain_order_minhash(t) for t in made]


def test_fingerprints_order(spark):
    """Swapped halves: near the likeness of 64 independent permutations (0.39 at 40 words, 0.46 at 100)."""
    rng = random.Random(8)
    for n, low, high in ((40, 0.32, 0.46), (100, 0.38, 0.54)):
        made = [[f"w{rng.random()}" for _ in range(n)] for _ in range(50)]
        pairs = spark.createDataFrame([(" ".join(w), " ".join(w[n // 2 :] + w[: n // 2])) for w in made], "a string, b string")
        pairs = fingerprints.with_fingerprint(fingerprints.with_fingerprint(pairs, "a", "fa"), "b", "fb")
        assert low < pairs.agg(F.avg(fingerprints.likeness("fa", "fb"))).first()[0] < high


def test_forest(docs, rows):
    got = forest.joined(docs).collect()
    sets = [(d, set(forest.shingles(t).tolist())) for d, t in texts(rows)]
    want = collections.Counter()
    for i, (d, a) in enumerate(sets):
        want[d, sum(bool(a | b) and len(a & b) >= 0.8 * len(a | b) for j, (_, b) in enumerate(sets) if j != i)] += 1
    assert collections.Counter((r["doc_id"], r["n_links"]) for r in got) == want
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[103] == by[104] == by[3] == 3 and by[100] == 100 and by[6] == 6
    kept = forest.one_of_each(docs)
    assert kept.columns == docs.columns and {103, 104}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert sum(r["doc_id"] == 5 for r in kept.collect()) == 1


def test_one_of_each_shared_ids(spark):
    """Rows that share a doc_id are judged one by one; of repeated rows one stays."""
    rng = random.Random(4)
    a, b, c = (text(rng, 60) for _ in range(3))
    made = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c + " tail"), (4, None), (4, None), (None, a), (5, ""), (6, b)]
    got = forest.one_of_each(spark.createDataFrame(made, "doc_id long, text string")).collect()
    threes = [r for r in got if r["doc_id"] == 3]
    assert len(threes) == 1 and threes[0]["text"] in (c, c + " tail")
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got if r["doc_id"] != 3) == sorted([("1", a), ("2", b), ("4", "None"), ("4", "None"), ("5", "")])


def test_hot_group(spark):
    rng = random.Random(9)
    base = text(rng, 200).split()
    near = [" ".join(w if i != k else "zz" for i, w in enumerate(base)) for k in range(600)]
    got = forest.joined(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {599}


def test_long_chain(spark):
    """Texts that drift: each is linked to the one before and the one after only."""
    rng = random.Random(11)
    words = [f"w{rng.getrandbits(48):x}" for _ in range(8 * 2000 + 100)]
    made = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(2000)]
    got = forest.joined(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert len({r["class_id"] for r in got}) == 1
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: 1 + (0 < i < 1999) for i in range(2000)}


def test_repeated_rows(spark):
    """Repeated rows, shared ids and null ids that have near copies: links of each row against brute force."""
    rng = random.Random(12)
    a, b, c, d, e = (text(rng, 60) for _ in range(5))
    made = [(1, a), (1, a), (2, a + " tail"), (3, b), (3, c), (3, c), (4, b + " tail"), (5, c + " tail"), (None, d), (None, d), (6, d + " tail"), (None, e), (None, e + " tail"), (None, text(rng, 60))]
    sets = [set(forest.shingles(t).tolist()) for _, t in made]
    want = [(str(i), sum(len(x & y) >= 0.8 * len(x | y) for k, y in enumerate(sets) if k != j)) for j, ((i, _), x) in enumerate(zip(made, sets))]
    got = forest.joined(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == sorted(want)


def test_lcp_merge():
    rng = np.random.default_rng(2)
    keys = rng.integers(97, 99, (3000, lcp_merge.K), np.uint8)
    keys[:500] = keys[500:1000]
    runs, order = [], []
    for part in np.array_split(np.arange(3000), 5):
        o, shared = lcp_merge.sort_run(keys[part])
        runs.append(lcp_merge.Run(lcp_merge.pack(keys[part][o], shared, np.stack([part[o], part[o]], 1), [b"%016d" % i for i in range(3000)])))
    for shared, run, ref, count in lcp_merge.merge(runs):
        order += [(shared if i == 0 else lcp_merge.K, int(runs[run].place[ref + i])) for i in range(count)]
    got = [keys[i].tobytes() for _, i in order]
    assert got == sorted(k.tobytes() for k in keys)
    for (shared, _), a, b in zip(order[1:], got, got[1:]):
        assert shared == next((i for i in range(lcp_merge.K) if a[i] != b[i]), lcp_merge.K)


def without_repeats(raw):
    seen = collections.Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    want = collections.Counter()
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\x01" * 400
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[suffixes_digest(b), len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept] = 1
    return want


def removed(docs):
    return collections.Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in suffixes.repeated(docs).collect())


def test_suffixes(docs, rows):
    assert removed(docs) == without_repeats([t.encode() for _, t in texts(rows)])
    assert not [t for t in docs.sparkSession.catalog.listTables() if t.name.startswith("tarnweb_texts")]


def test_suffixes_common_gram(spark, monkeypatch):
    """A passage in every text, runs so small that most keys cross them, and more ranges than keys."""
    rng = random.Random(13)
    passage = text(rng, 8)[:40]
    block = text(rng, 100)
    made = [(i, text(rng, 90) + passage + (block if i % 3 == 0 else text(rng, 60)) + passage) for i in range(24)]
    monkeypatch.setattr(suffixes, "RUN_ANCHORS", 20)
    want = without_repeats([t.encode() for _, t in made])
    d = spark.createDataFrame(made, "doc_id long, text string")
    assert removed(d) == want
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "150")
        assert removed(d) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert suffixes.splitters_of([b"c", b"a", b"a"], 9) == [b"a", b"c"] and len(suffixes.splitters_of([bytes([i]) for i in range(99)], 7)) == 6


def suffixes_digest(b):
    return bytes.fromhex(hashlib.sha256(b).hexdigest()[:32])


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    for df in (mixing.mix(none), token_counts.count_tokens(none), pii.detect(none), token_files.encode_documents(spark, none), decontaminate.judged(none, items), fingerprints.fingerprinted(none), forest.joined(none), suffixes.repeated(none)):
        assert df.count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_crowded_prefixes(spark):
    """A passage that many texts share crowds prefixes; the links of near copies among them are all found."""
    rng = random.Random(21)
    passage = text(rng, 90)
    made = [(i, passage + " " + text(rng, 70)) for i in range(700)]
    made += [(1000 + i, t + " tail") for i, t in made[:60]]
    sets = {d: set(forest.shingles(t).tolist()) for d, t in made}
    want = {d: sum(len(x & y) >= 0.8 * len(x | y) for e, y in sets.items() if e != d) for d, x in sets.items()}
    got = {r["doc_id"]: r["n_links"] for r in forest.joined(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == want and sum(want.values()) == 120


def test_forest_bounds():
    depths = forest.crowded_depths(0.8, 0.99999)
    assert depths == sorted(depths, reverse=True) and depths[0] == forest.DEPTH
    for n, d in enumerate(depths):
        floor = forest.floor_depth(0.8, 0.99999)
        assert (1 - 0.8**floor) ** (forest.TREES - n) * (1 - 0.8**d) ** n <= 5e-6


def test_pieces_shrink():
    """The table of pieces keeps its answers when it is cut to the half used most."""
    import public_tokenizers
    from tarnweb.llm import tokens
    from tokenizers import Tokenizer

    rng, old = random.Random(5), tokens.MAX_PIECES
    made = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(9000)}," for _ in range(60)) for _ in range(120)]
    try:
        tokens.MAX_PIECES = 700
        for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
            own, whole = tokens.Pieces(name), Tokenizer.from_file(public_tokenizers.path(name))
            for i in range(0, 120, 20):
                ids, lengths = own.encode(made[i : i + 20])
                want = [whole.encode(t, add_special_tokens=False).ids for t in made[i : i + 20]]
                assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))
    finally:
        tokens.MAX_PIECES = old


def test_added_spans(spark):
    """Secrets that the labelers agree on are added where they stand; digits that only look like a card are not."""
    made = [(i, f"said the mist {i} times, token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and then commit {hashlib.sha1(str(-i).encode()).hexdigest()[:12]} went") for i in range(40)]
    made += [(100 + i, f"number {4111111111111112 + 10 * i} of the list, mail a{i}@site.example.com") for i in range(40)]
    made += [(200, None), (201, "\U0001f600 password: hunter2hunter2 x"), (202, " ".join(f"+1 ({i:03d}) 555-{i:04d}x" for i in range(1000)))]
    got = {r["doc_id"]: r for r in pii.detect(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for d, t in made:
        want = [m.span(1) for m in re.finditer('token = "([0-9a-f]{40})"', t or "")]
        assert [(s["start"], s["end"]) for s in got[d]["secret"]][: len(want)] == want
        assert len(got[d]["secret"]) == len(want) or d == 201
        assert not got[d]["card_like"]
        assert [(s["start"], s["end"]) for s in got[d]["phone"]] == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t or "")]
    assert len(got[202]["phone"]) == 1000

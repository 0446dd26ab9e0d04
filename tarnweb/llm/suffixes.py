"""Suffix-array deduplication: bytes under a long string that occurs again go.

The suffix array is sampled. In every WINDOW-byte string the K-byte gram of least
hash (the rightmost of equal ones) is its anchor; equal strings have their
anchors in the same place, so a string can only occur again where its anchor
does. Suffixes at anchors are sorted in runs, front-coded and dealt out by
ranges, and each range is merged by a loser tree that never compares known
prefixes again (:mod:`lcp_merge`). Anchors whose prefix with a neighbour is K
bytes long are shared. A key that stands twice in one run is shared already: its
places leave the run at once, and one of them, marked, stands for it in the
merge, so a key comes to a range at most once a run, however common it is.

Shared anchors then tell which strings occur again. The strings of an
anchor form cells by the anchor's offset in them. If all strings of a cell
together (their union) occur elsewhere under the same offsets, the whole cell is
repeated. If what all strings of the cell have in common (its core) stands under
just one union, no string of it occurs elsewhere. Only the cells in between, at
the edges of passages, have their strings compared one by one; a union takes
part in that once, however often it occurs. Groups of any size are only counted,
never gathered.

Equal texts are one text; a text with copies goes as a whole. Distinct texts are
written once, bucketed by digest, to the shared folder, so later passes join to
them without moving texts.

Defined cases: null text is empty; texts under WINDOW bytes lose nothing; rows
with one doc_id are separate documents; an empty table gives an empty result;
extra columns are ignored. Unions and strings are the same if a 64-bit hash and a
check of 31 bits agree, a polynomial modulo a prime that has nothing in common with
the hash: what the hash alone confuses, the check tells apart. Cores need the hash
only, as cores that it confuses are compared string by string.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, in_slices, partitions, read, ship, shared_dir, stash
from .lcp_merge import K, Run, merge, pack, ranges, sort_run

WINDOW, CELL = 400, 128
#: Anchors of a sorted run at most; texts that the range limits come from (or a
#: PARTITION_TEXTS-th of the ranges, if more), and keys of each.
RUN_ANCHORS, SPLITTER_TEXTS, SPLITTER_KEYS, PARTITION_TEXTS = 400_000, 512, 64, 8
#: Mark of a place whose key is known to be shared.
GIVEN = 1 << 31
U = np.uint64
BASE = 0xD1342543DE82EF95
MIX = U(0x9E3779B97F4A7C15)
LOW = U((1 << 24) - 1)


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, U(BASE), U)]))
                self.down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, U(pow(BASE, -1, 2**64)), U)]))


_POWERS = _Powers()


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    _POWERS.need(len(raw) + 1)
    out = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * _POWERS.up[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start, end) -> np.ndarray:
    """Hash of the bytes from start to end; arrays or slices of one length."""
    h = (prefix[end] - prefix[start]) * _POWERS.down[start]
    h ^= h >> U(31)
    h *= MIX
    h ^= h >> U(29)
    return h


#: The prime and the base of the check.
PRIME, CHECK_BASE = (1 << 31) - 1, 1103515245


class _Residues:
    """Powers of the check's base and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(CHECK_BASE, size, PRIME)) % U(PRIME)])
            self.down = np.concatenate([self.down, self.down * U(pow(CHECK_BASE, -size, PRIME)) % U(PRIME)])


_RESIDUES = _Residues()


def prefix_checks(raw: np.ndarray) -> np.ndarray:
    _RESIDUES.need(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * _RESIDUES.up[: len(raw)] % U(PRIME), out=sums[1:])
    return sums % U(PRIME)


def span_check(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """31 bits of the bytes from start to end."""
    return ((prefix[end] + U(PRIME) - prefix[start]) % U(PRIME) * _RESIDUES.down[start] % U(PRIME)).astype(np.int32)


def anchors_of(prefix: np.ndarray) -> np.ndarray:
    """Anchor of the string that starts at each place; never falling."""
    n = len(prefix) - 1
    grams = n - K + 1
    h = span_hash(prefix, slice(0, grams), slice(K, grams + K))
    place = np.arange(grams, dtype=U)
    h = (h & ~LOW) | (LOW - (place & LOW))
    width = WINDOW - K + 1
    strings = n - WINDOW + 1
    rows = -(-grams // width)
    x = np.full(rows * width, U(2**64 - 1), U)
    x[:grams] = h
    x = x.reshape(rows, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:strings], ahead[width - 1 : width - 1 + strings])
    at = np.arange(strings, dtype=np.int64)
    return at + ((((LOW - (least & LOW)).astype(np.int64)) - at) & int(LOW))


def _segments(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, last string) of each run of strings."""
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return anchor[first], first, np.concatenate([first[1:], [len(anchor)]]) - 1


def _anchor_keys(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(raw, np.uint8)
    place = _segments(anchors_of(prefix_hashes(a)))[0]
    return a[place[:, None] + np.arange(K)], place


def _some_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SPLITTER_KEYS anchor keys of each text, spread over it."""
    for b in batches:
        keys = []
        for raw in b.column("raw").to_pylist():
            k = _anchor_keys(raw)[0]
            keys += [x.tobytes() for x in k[:: -(-len(k) // SPLITTER_KEYS)]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])


def _runs(splitters: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        keys: list[np.ndarray] = []
        refs: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            k, r = np.concatenate(keys), np.concatenate(refs)
            order, shared = sort_run(k)
            k, r = k[order], r[order]
            first = np.flatnonzero(shared < K) if len(shared) else np.zeros(0, np.int64)
            counts = np.diff(np.concatenate([first, [len(k)]]))
            again = np.repeat(counts > 1, counts)
            own = r[again][np.argsort(r[again][:, 0], kind="stable")]
            k, shared, r = k[first], shared[first], r[first]
            r[counts > 1, 1] |= GIVEN
            cuts = ranges(k, splitters)
            out = [(i, pack(k[a:b], shared[a:b], r[a:b], texts)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            begin = np.flatnonzero(np.concatenate([[True], own[1:, 0] != own[:-1, 0]])) if len(own) else np.zeros(0, np.int64)
            given = [texts[i] for i in own[begin, 0]]
            spread = [int.from_bytes(d[:4], "big") % (len(splitters) + 1) for d in given]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([begin, [len(own)]]), pa.int32()), pa.array(own[:, 1], pa.int32()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in out] + spread, pa.int32()), pa.array([b for _, b in out] + [None] * len(given), pa.binary()),
                    pa.array([None] * len(out) + given, pa.binary()), pa.concat_arrays([pa.nulls(len(out), pa.list_(pa.int32())), lists]),
                ],
                names=["range", "block", "digest", "places"],
            )

        for b in batches:
            for digest, raw in zip(b.column("digest").to_pylist(), b.column("raw").to_pylist()):
                if len(raw) < WINDOW:
                    continue
                k, place = _anchor_keys(raw)
                keys.append(k)
                refs.append(np.stack([np.full(len(place), len(texts)), place], 1))
                texts.append(digest)
                size += len(place)
                if size >= RUN_ANCHORS:
                    yield flush()
                    texts, keys, refs, size = [], [], [], 0
        if size:
            yield flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the blocks of each range; places of keys that stand twice or more.
    Places that are known already pass through."""

    def out(digests: list, places: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["digest", "places"])

    blocks: dict[int, list[bytes]] = {}
    for b in batches:
        known = b.filter(b.column("block").is_null())
        yield pa.RecordBatch.from_arrays([known.column("digest"), known.column("places")], names=["digest", "places"])
        for r, block in zip(b.column("range").to_pylist(), b.column("block").to_pylist()):
            if block is not None:
                blocks.setdefault(r, []).append(block)
    for r in sorted(blocks):
        runs = [Run(x) for x in sorted(blocks.pop(r))]
        digests: list[bytes] = []
        places: list[list[int]] = []
        group: list[tuple[int, int]] = []

        def close() -> None:
            own = [(runs[i], ref, int(runs[i].place[ref])) for i, ref in group]
            if len(own) > 1 or (own and own[0][2] & GIVEN):
                for run, ref, place in own:
                    if not place & GIVEN:
                        digests.append(run.ids[run.text[ref]])
                        places.append([place])

        for shared, i, ref, _ in merge(runs):
            if shared < K:
                close()
                group = []
            group.append((i, ref))
            if len(digests) > 50_000:
                yield out(digests, places)
                digests, places = [], []
        close()
        yield out(digests, places)


def _cells(bits: int):
    """Cells of the strings whose anchor is shared: core, whole, check, first, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, parts = [], []
            for digest, raw, places in zip(b.column("digest").to_pylist(), b.column("raw").to_pylist(), b.column("places").to_pylist()):
                own = np.frombuffer(raw, np.uint8)
                prefix, checks = prefix_hashes(own), prefix_checks(own)
                anchor, first, last = _segments(anchors_of(prefix))
                pick = np.isin(anchor, np.array(places, np.int64))
                anchor, first, last = anchor[pick], first[pick], last[pick]
                for c in range(-(-(WINDOW - K + 1) // CELL)):
                    near, far = c * CELL, min(c * CELL + CELL - 1, WINDOW - K)
                    low, high = np.maximum(anchor - last, near), np.minimum(anchor - first, far)
                    some = low <= high
                    if not some.any():
                        continue
                    p, low, high = anchor[some], low[some], high[some]
                    core = span_hash(prefix, p - near, p - far + WINDOW) + U(c)
                    whole = span_hash(prefix, p - high, p - low + WINDOW) + ((low << 9) | high).astype(U) * MIX
                    check = span_check(checks, p - high, p - low + WINDOW) ^ (((low << 9) | high) << 12)
                    parts.append(np.stack([_cut(core, bits), _cut(whole, bits), check, p - high, p - low], 1))
                    digests += [digest] * len(p)
            rows = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *[pa.array(rows[:, i].astype(np.int32) if i == 2 else rows[:, i]) for i in range(5)]], names=["digest", "core", "whole", "check", "first", "last"])

    return run


def _cut(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & U((1 << bits) - 1)).view(np.int64)


def _strings(bits: int):
    """Hash, check and start of every string of the given cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, hashes, checks, starts = [], [], [], []
            for digest, raw, cells in zip(b.column("digest").to_pylist(), b.column("raw").to_pylist(), b.column("cells").to_pylist()):
                own = np.frombuffer(raw, np.uint8)
                at = np.concatenate([np.arange(c["first"], c["last"] + 1) for c in cells])
                hashes.append(_cut(span_hash(prefix_hashes(own), at, at + WINDOW), bits))
                checks.append(span_check(prefix_checks(own), at, at + WINDOW))
                starts.append(at)
                digests += [digest] * len(at)
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(join(hashes)), pa.array(join(checks).astype(np.int32)), pa.array(join(starts))], names=["digest", "hash", "check", "first"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for digest, copies, raw, spans in zip(*[b.column(n).to_pylist() for n in ("digest", "copies", "raw", "spans")]):
            n = len(raw)
            step = np.zeros(n + 1, np.int64)
            if copies > 1 and n >= WINDOW:
                step[0] = 1
            for s in spans or ():
                step[s["first"]] += 1
                step[s["last"] + WINDOW] -= 1
            gone = np.cumsum(step[:n]) > 0
            edges = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if n else 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((digest, n, int(gone.sum()), edges, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _digest(text) -> F.Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """digest, copies, raw of the distinct texts, bucketed by digest, and the
    name of their table."""
    spark = docs.sparkSession
    raw = F.coalesce("text", F.lit(""))
    table = docs.select(_digest(raw).alias("digest"), raw.cast("binary").alias("raw")).groupBy("digest").agg(F.count("*").alias("copies"), F.first("raw").alias("raw"))
    name = f"tarnweb_texts_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    table.write.bucketBy(partitions(spark), "digest").sortBy("digest").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name), name


def splitters_of(keys: list[bytes], n: int) -> list[bytes]:
    """Up to n - 1 limits of ranges; all keys where they are fewer."""
    keys = sorted(set(keys))
    return keys if len(keys) < n else [keys[len(keys) * i // n] for i in range(1, n)]


def repeated(docs: DataFrame, columns: list[str] | None = None, bits: int = 64) -> DataFrame:
    """digest, n_bytes, n_removed, n_spans, kept_sha256, kept (or the columns
    asked for) of each distinct text of docs(text), from the shared folder. bits:
    how many of the hash count; fewer make work for the check, not other results."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    texts, name = _texts(docs)
    long = texts.where(F.octet_length("raw") >= WINDOW)
    # Only keys of K bytes reach the driver, SPLITTER_KEYS a text at most.
    some = max(SPLITTER_TEXTS, n // PARTITION_TEXTS)
    picked = long.join(F.broadcast(long.select("digest").orderBy("digest").limit(some)), "digest").select("raw")
    splitters = splitters_of([bytes(r["key"]) for r in picked.mapInArrow(in_slices(_some_keys), "key binary").collect()], n) if n > 1 else []
    runs = long.select("digest", "raw").mapInArrow(in_slices(_runs(splitters)), "range int, block binary, digest binary, places array<int>")
    merged = runs.repartitionById(n, F.col("range")).mapInArrow(in_slices(_shared), "digest binary, places array<int>")
    shared = merged.groupBy("digest").agg(F.flatten(F.collect_list("places")).alias("places"))  # at most the anchors of a text
    cells, at_cells = stash(texts.join(shared, "digest").select("digest", "raw", "places").mapInArrow(in_slices(_cells(bits)), "digest binary, core long, whole long, check int, first long, last long"), spark, "cells")
    wholes, at_wholes = stash(
        cells.groupBy("core", "whole", "check").agg(F.count("*").alias("n"), F.min(F.struct("digest", "first", "last")).alias("one")), spark, "wholes"
    )
    unsure = wholes.groupBy("core").agg(F.count("*").alias("wholes")).where("wholes > 1").select("core")
    all_of = cells.join(wholes.where("n > 1").select("core", "whole", "check"), ["core", "whole", "check"]).select("digest", "first", "last")
    compare = wholes.join(unsure, "core").select("one.*").groupBy("digest").agg(F.collect_list(F.struct("first", "last")).alias("cells"))
    strings, at_strings = stash(texts.join(compare, "digest").select("digest", "raw", "cells").mapInArrow(in_slices(_strings(bits)), "digest binary, hash long, check int, first long"), spark, "strings")
    twice = strings.groupBy("hash", "check").agg(F.count("*").alias("n")).where("n > 1").select("hash", "check")
    some_of = strings.join(twice, ["hash", "check"]).select("digest", "first", F.col("first").alias("last"))
    spans = all_of.unionByName(some_of).groupBy("digest").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # at most the strings of a text
    found = texts.join(spans, "digest", "left").select("digest", "copies", "raw", "spans").mapInArrow(
        in_slices(_kept), "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    out, _ = stash(found.select(*(columns or found.columns)), spark, "kept")
    spark.sql(f"DROP TABLE {name}")  # its files are not the catalog's
    drop(spark, f"{shared_dir(spark)}/{name}", at_cells, at_wholes, at_strings)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated(docs, ["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return docs.select("doc_id", _digest(F.coalesce("text", F.lit(""))).alias("digest")).join(found, "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

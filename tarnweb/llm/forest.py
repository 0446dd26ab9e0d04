"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents become sets of 64-bit hashes of N words in a row. Documents with one
set are a class and are joined as one. Each class has TREES signatures of DEPTH
MinHash values; the signatures of one tree, sorted, are a prefix trie: classes
that share a prefix stand side by side.

Matching starts from whole signatures and shortens the matched prefix. Down to
`floor_depth`, the depth at which the recall expected at the threshold reaches the
target, prefixes are shortened in every tree where few enough classes (CROWD)
share the shortened prefix. Where more do, the prefix stays as long as the other
trees allow: a class may keep longer prefixes in so many trees that it is still
found with the target recall, by prod(1 - threshold ** depth of each tree); if it
could not be, its crowded prefixes are shortened to the floor too, and no class of
that trie node is left out. So crowds that come from common passages stay apart,
and groups of near copies, crowded in all trees, stay whole.

Classes under one uncrowded prefix are compared by a sketch of SKETCH bytes, and
those whose sketches agree often enough (chosen so that misses stay within the
target) become candidates; a node of m classes leaves at most m - 1 edges.

Candidates form connected groups. A group is cut into blocks by hash and bounded
by shingles, each pair of blocks is a tile, and a tile is verified exactly in one
task by an inverted list of its shingles, pairs of the group that share no prefix
included. Rows that leave a tile are per class (its
links and whom it is connected to), never per pair. A group of g near copies still
costs about g * g / 2 comparisons, as links have to be counted, and g * g / BLOCK
rows. Groups of links come from rounds of label spreading over per-class edges,
until no label changes, each written to the shared folder.

Words are runs without ASCII white space, lower-cased. A text with fewer than N
words has one shingle, all its words.

Defined cases: null, empty or wordless texts have no shingles and link to
nothing; rows with one doc_id are separate documents, each judged on its own
text; repeated rows are copies of each other; a class of rows without any doc_id
reports null; an empty table gives an empty result; extra columns are
kept by `one_of_each`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, in_slices, partitions, read, ship, stash

N, THRESHOLD, RECALL = 5, 0.8, 0.99999
TREES, DEPTH, SKETCH = 28, 6, 64
#: Classes that may share a prefix before it counts as crowded.
CROWD = 256
#: Bounds of a block: classes and shingles.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Bytes of a tree's signature: DEPTH values of 16 bits.
PATH = 2 * DEPTH
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20_240_501))
A = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * U(2) + U(1)
B = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def floor_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which the recall expected at the threshold reaches
    the target; half of the misses allowed are left to the sketches."""
    depth = DEPTH
    while depth > 1 and (1 - threshold**depth) ** TREES > (1 - recall) / 2:
        depth -= 1
    return depth


def crowded_depths(threshold: float, recall: float) -> list[int]:
    """By number of crowded trees of a class: the longest prefix they may keep."""
    floor = floor_depth(threshold, recall)

    def enough(crowded: int, depth: int) -> bool:
        return (1 - threshold**floor) ** (TREES - crowded) * (1 - threshold**depth) ** crowded <= (1 - recall) / 2

    return [next((d for d in range(DEPTH, floor, -1) if enough(n, d)), floor) for n in range(TREES + 1)]


def sketch_cut(threshold: float, recall: float) -> int:
    """The most equal bytes to ask for, so that sketches of classes at the
    threshold miss with at most half the probability allowed (binomial)."""
    missed, cut = 0.0, 0
    while cut < SKETCH:
        missed += math.comb(SKETCH, cut) * threshold**cut * (1 - threshold) ** (SKETCH - cut)
        if missed > (1 - recall) / 2:
            return cut
        cut += 1
    return cut


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of n words in a row."""
    import xxhash

    words = text.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    size = max(len(h) - n + 1, 1)
    out = np.zeros(size, U)
    for j in range(min(n, len(h))):
        out = (out ^ h[j : j + size]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """TREES x DEPTH MinHash values of 16 bits (least of 64-bit multiply-adds, mixed)."""
    out = np.full(len(A), U(2**64 - 1), U)
    for i in range(0, len(s), 2048):
        out = np.minimum(out, (s[i : i + 2048, None] * A + B).min(0))
    out = (out ^ (out >> U(29))) * U(0xD6E8FEB86659FD93)
    return (out >> U(48)).astype(">u2").reshape(TREES, DEPTH)


def sketch(sig: np.ndarray) -> bytes:
    """SKETCH bytes, from the values that matched prefixes reach last."""
    return (sig[:, ::-1].T.ravel()[:SKETCH] & 0xFF).astype(np.uint8).tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        digest, size, trees, small = [], [], [], []
        for t in b.column("text").to_pylist():
            s = shingles(t or "")
            sig = signature(s) if len(s) else None
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            size.append(len(s))
            trees.append(sig.tobytes() if len(s) else None)
            small.append(sketch(sig) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("key"), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(trees, pa.binary()), pa.array(small, pa.binary())],
            names=["doc_id", "key", "set", "size", "trees", "sketch"],
        )


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width bytes of a binary column whose values have one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _linked(node: np.ndarray, sketches: np.ndarray, cut: int) -> np.ndarray:
    """For rows sorted by node: the first row of each row's candidates, itself
    for a row without. All pairs of a node are compared, by distance in the
    order, and only pairs not yet together are joined."""
    root = np.arange(len(node))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, far = np.arange(len(node)), 0
    while len(left):
        far += 1
        left = left[left + far < len(node)]
        left = left[node[left] == node[left + far]]
        apart = left[root[left] != root[left + far]]
        for i in range(0, len(apart), 1 << 16):
            some = apart[i : i + (1 << 16)]
            for x in some[(sketches[some] == sketches[some + far]).sum(1) >= cut].tolist():
                lo, hi = sorted((top(x), top(x + far)))
                root[hi] = lo
        while (root[root] != root).any():
            root = root[root]
    return root


def _tries(depth: int, cut: int):
    """Of sorted tries (tree, path, set, sketch): an edge (a, b) for each class
    linked within its node, and all classes (a, tree, path) of crowded nodes. Only
    the rows of one uncrowded node are held back."""
    names = ("tree", "path", "set", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros((0, 1), np.uint8), np.zeros((0, PATH), np.uint8), np.zeros((0, 16), np.uint8), np.zeros((0, SKETCH), np.uint8)]
        crowd = None  # the crowded node that rows still come from

        def closed(rows: list[np.ndarray], last: bool):
            """Rows to give out of these, and those to keep for the next batch."""
            nonlocal crowd
            tree, path, own, sketches = rows
            head = np.concatenate([tree, path[:, : 2 * depth]], axis=1)
            node = np.concatenate([[0], np.cumsum((head[1:] != head[:-1]).any(1))]) if len(head) else np.zeros(0, np.int64)
            size = np.bincount(node) if len(node) else np.zeros(0, np.int64)
            crowded = size > CROWD
            if crowd is not None and len(head) and head[0].tobytes() == crowd:
                crowded[0] = True
            hold = 0 if last or not len(head) or crowded[-1] else size[-1]
            crowd = head[-1].tobytes() if len(head) and crowded[-1] else None
            end = len(node) - hold
            many = crowded[node[:end]]
            few = np.flatnonzero(~many & (size[node[:end]] > 1))
            root = _linked(node[few], sketches[few], cut)
            child = np.flatnonzero(root != np.arange(len(few)))
            many = np.flatnonzero(many)
            a = [own[i].tobytes() for i in np.concatenate([few[child], many])]
            b = [own[i].tobytes() for i in few[root[child]]] + [None] * len(many)
            blank = [None] * len(child)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(a, pa.binary()), pa.array(b, pa.binary()),
                    pa.array(blank + tree[many, 0].tolist(), pa.int32()), pa.array(blank + [path[i].tobytes() for i in many], pa.binary()),
                ],
                names=["a", "b", "tree", "path"],
            )
            return out, [x[end:] for x in rows]

        for batch in batches:
            columns = [batch.column(n) for n in names]
            new = [columns[0].to_numpy().astype(np.uint8)[:, None], *[_fixed(c, w) for c, w in zip(columns[1:], (PATH, 16, SKETCH))]]
            out, kept = closed([np.concatenate(x) for x in zip(kept, new)], False)
            yield out
        yield closed(kept, True)[0]

    return in_slices(run, rows=1 << 13)


def star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: of the b of one a, a and all others
    are linked to the least. A dense group comes down to about an edge a node."""
    ends = edges.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("ends"))
    again = ends.select(F.explode(F.concat(F.array("a"), "ends")).alias("a"), F.col("least").alias("b"))
    return again.where("a <> b").distinct()


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """node, group (least node reached) for edges (a, b). In a round every node
    and the node its label names take the least label among the node's
    neighbours, and labels are followed once, so whole groups hang themselves
    onto others and a chain of 2000 in random order takes about 15 rounds, one of
    a million about 26. Rounds go on until no label changes; labels only fall, so
    they end, and a label that no neighbour undercuts is the group's least.
    Rounds are written to the shared folder."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, at_edges = stash(both, spark, "edges")
    labels, at = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("group")).withColumnRenamed("a", "node"), spark, "labels")
    changed = True
    while changed:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("group").alias("near"))
        found = labels.join(near, labels["node"] == near["a"]).select("node", "group", "near")
        own = F.struct("node", F.col("group").alias("was"), F.least("group", "near").alias("mid"))
        hook = F.when(F.col("near") < F.col("group"), F.struct(F.col("group").alias("node"), F.lit(None).cast("binary").alias("was"), F.col("near").alias("mid")))
        told = found.select(F.inline(F.filter(F.array(own, hook), lambda x: x.isNotNull())))
        step = told.groupBy("node").agg(F.max("was").alias("was"), F.min("mid").alias("mid"))
        ahead = labels.select(F.col("node").alias("mid"), F.col("group").alias("far"))
        step = step.join(ahead, "mid").select("node", "was", F.least("mid", "far").alias("group"))
        step, at_step = stash(step, spark, "labels")
        changed = step.where(F.col("was") != F.col("group")).limit(1).count()
        drop(spark, at)
        labels, at = step.drop("was"), at_step
    drop(spark, at_edges)
    return labels


def _tile(node: list[bytes], side: np.ndarray, weight: np.ndarray, sets: list[np.ndarray], threshold: float, same: bool):
    """Links of each class of a tile and a root in it: two blocks, or one."""
    n = len(node)
    links, root = np.zeros(n, np.int64), np.arange(n)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.concatenate([begin, [len(flat)]]))
    shared = np.zeros((n, n), np.float32)
    column = np.repeat(np.arange(len(begin)), count)
    often = np.repeat(count > 1, count)
    column, who = column[often], owner[often]
    _, column = np.unique(column, return_inverse=True)
    width = 4096
    edge = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for lo, hi in zip(edge[:-1], edge[1:]):
        part = np.zeros((n, width), np.float32)
        part[who[lo:hi], column[lo:hi] % width] = 1
        shared += part @ part.T
    common = shared.astype(np.int64)
    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if not same:
        linked &= side[:, None] != side[None, :]
    links += linked.astype(np.int64) @ weight
    left = np.ones(n, bool)
    for i in range(n):  # breadth first from each class not yet reached
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            new = np.flatnonzero(linked[queue].any(0) & left)
            left[new] = False
            root[new] = i
            queue = new.tolist()
    return links, root


def _verify(threshold: float):
    def finish(rows: list[tuple]) -> pa.RecordBatch:
        same = rows[0][1] == rows[0][2]
        sets = [np.frombuffer(r[6], "<u8") for r in rows]
        node = [r[4] for r in rows]
        links, root = _tile(node, np.array([r[3] for r in rows]), np.array([r[5] for r in rows]), sets, threshold, same)
        return pa.RecordBatch.from_arrays(
            [pa.array(node, pa.binary()), pa.array(links), pa.array([node[i] for i in root], pa.binary())], names=["node", "links", "root"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition is sorted by tile; a tile is kept whole, the rest flows."""
        names = ("group", "low", "high", "block", "node", "weight", "shingles")
        rows = itertools.chain.from_iterable(zip(*[b.column(n).to_pylist() for n in names]) for b in batches)
        for _, tile in itertools.groupby(rows, key=lambda r: r[:3]):
            yield finish(list(tile))

    return in_slices(run)


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t or "").astype("<u8").tobytes() for t in b.column("text").to_pylist()]
        rest = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in rest], pa.array(sets, pa.binary())], names=[*rest, "shingles"])


def candidates(classes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, str]:
    """Edges (a, b) between the sets of candidate classes, and where they are kept."""
    spark = classes.sparkSession
    floor = floor_depth(threshold, recall)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    members = classes.select("set", "sketch", "trees", tree).select("tree", F.substr("trees", F.col("tree") * PATH + 1, F.lit(PATH)).alias("path"), "set", "sketch")
    head = F.substring("path", 1, 2 * floor)
    tries = members.repartition(partitions(spark), "tree", head).sortWithinPartitions("tree", "path", "set")
    found, at_found = stash(tries.mapInArrow(_tries(floor, sketch_cut(threshold, recall)), "a binary, b binary, tree int, path binary"), spark, "tries")
    edges = found.where("b is not null").select("a", "b").distinct()
    crowded = found.where("b is null").select(F.col("a").alias("set"), "tree", "path", head.alias("head"))
    if crowded.limit(1).count():
        # A node's prefix is as short as the class in it that needs it shortest.
        allowed = F.element_at(F.array(*map(F.lit, crowded_depths(threshold, recall))), (F.col("trees") + 1).cast("int"))
        depth_of = crowded.groupBy("set").agg(F.count("*").alias("trees")).select("set", allowed.alias("depth"))
        nodes = crowded.join(depth_of, "set").groupBy("tree", "head").agg(F.min("depth").alias("depth"))
        placed = crowded.join(nodes, ["tree", "head"]).select("set", "tree", F.substr("path", F.lit(1), 2 * F.col("depth")).alias("prefix"))
        least = placed.groupBy("tree", "prefix").agg(F.min("set").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        starred = placed.join(least, ["tree", "prefix"]).where("set <> b").select(F.col("set").alias("a"), "b").distinct()
        edges = edges.unionByName(starred)
    edges, at_edges = stash(edges, spark, "candidates")
    drop(spark, at_found)
    return edges, at_edges


def _row_id(doc_id: Column) -> list[Column]:
    """doc_id as join keys that let null meet null."""
    return [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id")]


def _grouped(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """doc_id, key, class_id, set_id, n_links, first for each row of docs(doc_id,
    text). key: hash of the text; first: (doc_id, key) of the one row of the class
    that stays where only one may: the least that has a doc_id, or if none has one
    the least; null for rows without shingles."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    rows, _ = stash(keyed.mapInArrow(in_slices(_sets), "doc_id long, key long, set binary, size long, trees binary, sketch binary"), spark, "sets")
    # One row a class. The trees follow from the set, so any row's will do.
    classes = rows.where("set is not null").groupBy("set").agg(
        F.min("doc_id").alias("set_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("own_first"),
        F.min("key").alias("any_key"),
        F.count("*").alias("weight"),
        F.max("size").alias("size"),
        F.first(F.struct("trees", "sketch")).alias("hashes"),
    )
    classes, at_classes = stash(classes, spark, "classes")
    edges, at_edges = candidates(classes.select("set", "hashes.*"), threshold, recall)
    groups = components(star(edges), spark)
    drop(spark, at_edges)
    # Blocks by hash, so that no block and no group is gathered to number it.
    sized = groups.join(classes, groups["node"] == classes["set"])
    blocks = sized.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # The text of one row of each class that has candidates: of own_first, or of any where no row has a doc_id.
    text_key = F.coalesce(F.col("own_first.key"), F.col("any_key")).alias("key")
    placed = sized.join(blocks, "group").select(
        *_row_id(F.col("set_id")), text_key, "node", "group", "weight", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    )
    texts = keyed.select(*_row_id(F.col("doc_id")), "key", "text").join(placed, ["id", "no_id", "key"]).dropDuplicates(["id", "no_id", "key"])
    fields = "node binary, group binary, weight long, blocks int, block int, shingles binary"
    with_sets = texts.select("node", "group", "weight", "blocks", "block", "text").mapInArrow(in_slices(_with_shingles), fields)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = with_sets.select("*", other.alias("with")).select(
        "group", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "weight", "shingles"
    )
    dealt = tiles.repartition(4 * partitions(spark), "group", "low", "high").sortWithinPartitions("group", "low", "high", "node")
    verified, _ = stash(dealt.mapInArrow(_verify(threshold), "node binary, links long, root binary"), spark, "links")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(star(verified.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), spark)
    # Where no row of a class has a doc_id, the one of least text hash is first.
    own = F.coalesce("own_first", F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("any_key").alias("key")))
    classes = classes.withColumn("own_least", own)
    leader = found.join(classes.select("set", "own_first", "own_least"), F.col("node") == F.col("set")).select("node", "group", "own_first", "own_least")
    least_id = leader.groupBy("group").agg(F.coalesce(F.min("own_first"), F.min("own_least")).alias("class_first"))
    by_node = leader.join(least_id, "group").select(F.col("node").alias("set"), "class_first")
    first = F.coalesce("class_first", "own_least")
    result = (
        classes.select("set", "set_id", "own_least", "weight")
        .join(links.withColumnRenamed("node", "set"), "set", "left")
        .join(by_node, "set", "left")
        .select("set", "set_id", first["doc_id"].alias("class_id"), first.alias("first"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    result, _ = stash(result, spark, "classes-out")
    return rows.select("doc_id", "key", "set").join(result, "set", "left").select(
        "doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "first"
    )


def joined(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, set_id, n_links for docs(doc_id, text).

    class_id: least doc_id of the documents reached through links; set_id: least
    doc_id with the same shingles; n_links: other documents at or above the
    threshold, copies included."""
    return _grouped(docs, threshold, recall).select("doc_id", "class_id", "set_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class, the one of least doc_id (of least text
    hash among rows that share it, and in classes without any doc_id); repeated
    rows are a class like any other, so one of them stays. Rows of null doc_id
    take part by their text hash: beside a row with a doc_id they go. Documents
    without shingles stay."""
    groups, _ = stash(_grouped(docs.select("doc_id", "text"), threshold, recall).where("first is not null"), docs.sparkSession, "one-of-each")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    gone = groups.where(~same).select(F.col("doc_id").alias("_gone"), F.col("key").alias("_key")).distinct()
    again = groups.where(same).groupBy(F.col("doc_id").alias("_gone"), F.col("key").alias("_key")).count().where("count > 1").drop("count")

    def match(other: DataFrame):
        return rows["row.doc_id"].cast("long").eqNullSafe(other["_gone"]) & (rows["text_key"] == other["_key"])

    # The row travels as one struct, whatever its columns are called.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("text_key", F.xxhash64("row.text"))
    rows = rows.join(gone, match(gone), "left_anti")
    if again.limit(1).count():
        repeated = rows.join(again, match(again), "left_semi").withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "text_key"]).drop("id")
        rows = rows.join(again, match(again), "left_anti").unionByName(repeated)
    return rows.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over all documents."""
    return joined(read(spark, sf_dir, "documents"))

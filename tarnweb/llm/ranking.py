"""Ranked lexical search: variable-block-max WAND over shards of documents.

1. One pass over whole texts gives each document's number of terms and the counts
   of those of its terms that the vocabulary holds (all, if none is given). N, L
   and document frequencies are sums over that table, so they cover all rows.
2. The index has a row for each shard and term. A shard is up to SHARD_DOCS
   consecutive documents of a partition, so nothing is shuffled to build it.
   Postings are places of documents in the order of doc_id, and their impacts: the
   score without the term's weight. A dynamic programme cuts a list into blocks:
   it minimises the sum over postings of the block's greatest impact less their
   own, with BLOCK_COST for each block, over blocks of LENGTHS postings. Greatest
   impacts and last places of blocks are stored beside the postings.
3. Search runs shard by shard, an item at a time. Between two borders of blocks of
   an item's terms the sum of the blocks' bounds does not change; where it is below
   the least score that still counts, no document is looked at and no block is
   read. This is WAND's pivot test, made for all such stretches at once. Stretches
   are taken from the highest bound on, the tenth score rises, and the search ends
   when no bound left reaches it. Equal bounds are looked at too, so ties are
   right and results are exact. A shard gives at most k rows an item, and a
   ranking of these gives the item's.

All arithmetic but the logarithm is on 64-bit integers. Items are taken in portions
of ITEMS, each of which is sent to the tasks; a vocabulary of more than VOCABULARY
terms is not sent, and the index then holds all terms.

Defined cases: null or termless texts are in no list and do not count in N; rows
that share a doc_id are ranked one by one; null doc_ids come after others at equal
scores; repeated (item_id, text) rows of the queries are answered once, and items
that share an id but not the text are ranked apart; items without terms or matches
have no rows; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_slices, read, ship, stash

TOP = 10
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1 << 20
ITEMS, VOCABULARY = 2_000, 300_000
#: Lengths of blocks, and what a block costs in the sum of errors, as a share of
#: the list's mean impact.
LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
BLOCK_COST = 4.0
#: Constants of the score (fixed values).
SCALE, B_TENTHS = 1_000_000_000, 75

#: Bytes that stand between terms become blanks, A-Z become a-z.
_BETWEEN = bytes(i for i in range(128) if not (chr(i).isalnum()))
_TABLE = bytes.maketrans(_BETWEEN + bytes(range(65, 91)), b" " * len(_BETWEEN) + bytes(range(97, 123)))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def _counter(vocabulary: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, terms, counts = [], [0], [], []
            for text in batch.column("text").to_pylist():
                own = terms_of(text)
                n.append(len(own))
                for term, count in Counter(own if vocabulary is None else filter(vocabulary.__contains__, own)).items():
                    terms.append(term)
                    counts.append(count)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return in_slices(run)


def counted(docs: DataFrame, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """doc_id, n (terms with repeats), terms, counts of each document."""
    ship(docs.sparkSession)
    sent = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        return _counter(None if sent is None else sent.value)(batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<string>, counts array<int>")


def statistics(docs: DataFrame) -> tuple[int, int]:
    """N and L of a counted table."""
    row = docs.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    return row["N"], row["L"]


def weights(docs: DataFrame, n_docs: int) -> DataFrame:
    """term, df, weight of each term of a counted table."""
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("weight"))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    m = 100 - B_TENTHS + (B_TENTHS * n * n_docs) // max(length, 1)
    return (SCALE * tf) // (1000 * tf + 8 * m)


def block_ends(impact: np.ndarray) -> np.ndarray:
    """Ends of the blocks of a list: the least sum of bound errors and costs."""
    n = len(impact)
    if n < 2:
        return np.arange(1, n + 1)
    cost = BLOCK_COST * float(impact.mean())
    lengths = [x for x in LENGTHS if x <= n]
    best = np.full((n + 1, len(lengths)), np.inf)
    top, taken = impact.astype(np.float64), 1
    for c, length in enumerate(lengths):  # the greatest impact of every stretch of a length
        while taken < length:
            step = min(taken, length - taken)
            top = np.maximum(top[: n - taken - step + 1], top[step:])
            taken += step
        best[length:, c] = cost + length * top
    back = np.array(lengths)
    total, chosen = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for i in range(1, n + 1):
        k = i if i < lengths[-1] else 0
        few = np.searchsorted(back, k, "right") if k else len(back)
        sums = total[i - back[:few]] + best[i, :few]
        c = int(sums.argmin())
        total[i], chosen[i] = sums[c], back[c]
    ends, at = [], n
    while at:
        ends.append(at)
        at -= int(chosen[at])
    return np.array(ends[::-1])


def _shards(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Counted rows in portions of bounded size."""
    held, docs, postings = [], 0, 0
    for batch in rows:
        batch = batch.filter(pc.greater(batch.column("n"), 0))
        for a in range(0, len(batch), 1024):
            part = batch.slice(a, 1024)
            more = len(part.column("terms").flatten())
            if held and (docs + len(part) > SHARD_DOCS or postings + more > SHARD_POSTINGS):
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
            held.append(part)
            docs, postings = docs + len(part), postings + more
    if held:
        yield pa.Table.from_batches(held)


INDEX = "shard long, term string, doc_ids array<long>, places array<int>, impacts array<int>, ends array<int>, tops array<int>"


def _indexer(n_docs: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for number, table in enumerate(_shards(batches)):
            table = table.sort_by([("doc_id", "ascending")]).combine_chunks()  # nulls last
            lists = table.column("terms").combine_chunks() if table.num_rows else None
            per = np.diff(lists.offsets.to_numpy())
            place = np.repeat(np.arange(len(per), dtype=np.int32), per)
            coded = lists.flatten().dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            tf = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            impact = impacts(tf, table.column("n").to_numpy()[place].astype(np.int64), n_docs, length)
            order = np.argsort(code, kind="stable")
            code, place, impact = code[order], place[order], impact[order].astype(np.int32)
            shard = (TaskContext.get().partitionId() << 24) + number
            first = np.searchsorted(code, np.arange(len(names) + 1))
            yield _index_rows(shard, [None], [table.column("doc_id").combine_chunks()], [[]], [[]], [[]], [[]])
            for a in range(0, len(names), 512):
                out = ([], [], [], [], [], [])
                for t in range(a, min(a + 512, len(names))):
                    mine = slice(int(first[t]), int(first[t + 1]))
                    ends = block_ends(impact[mine])
                    tops = np.maximum.reduceat(impact[mine], np.concatenate([[0], ends[:-1]]))
                    for column, value in zip(out, (names[t], [], place[mine], impact[mine], ends, tops)):
                        column.append(value)
                yield _index_rows(shard, *out)

    return run


def _index_rows(shard: int, terms, doc_ids, places, impact, ends, tops) -> pa.RecordBatch:
    lists = lambda rows, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.concat_arrays([pa.array(r, kind) for r in rows]))
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(terms), pa.int64()), pa.array(terms, pa.string()), lists(doc_ids, pa.int64()), *[lists(x, pa.int32()) for x in (places, impact, ends, tops)]],
        names=["shard", "term", "doc_ids", "places", "impacts", "ends", "tops"],
    )


def build_index(docs: DataFrame, n_docs: int, length: int) -> DataFrame:
    """The index of a counted table: a row (shard, term) for each list, and one of
    null term with the doc_ids of the shard's places. Store it before searching."""
    return docs.select("doc_id", "n", "terms", "counts").mapInArrow(_indexer(n_docs, length), INDEX)


class Lists:
    """Postings and blocks of a shard by term."""

    def __init__(self, table: pa.Table):
        self.doc_ids = np.zeros(0)
        self.of: dict[str, tuple[np.ndarray, ...]] = {}
        for batch in table.to_batches():
            for i, term in enumerate(batch.column("term").to_pylist()):
                if term is None:
                    self.doc_ids = batch.column("doc_ids")[i].values
                    continue
                self.of[term] = tuple(batch.column(c)[i].values.to_numpy().astype(np.int64) for c in ("places", "impacts", "ends", "tops"))


def best(lists: Lists, query: dict[str, int], k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best documents of a shard for a query of weights
    by term, best first, equal scores by place."""
    terms = [(w, *lists.of[t]) for t, w in query.items() if w > 0 and t in lists.of]
    n = len(lists.doc_ids)
    if not terms or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lasts = [places[ends - 1] for _, places, _, ends, _ in terms]
    firsts = [places[np.concatenate([[0], ends[:-1]])] for _, places, _, ends, _ in terms]
    grid = np.unique(np.concatenate([*firsts, *[x + 1 for x in lasts]]))  # the first place of each stretch
    bound, block = np.zeros(len(grid), np.int64), []
    for (w, _, _, _, tops), first, last in zip(terms, firsts, lasts):
        at = np.searchsorted(last, grid)
        at[np.append(first, n)[at] > grid] = len(last)  # between two blocks
        block.append(at)
        bound += w * np.append(tops, 0)[at]
    stretch = np.argsort(-bound, kind="stable")
    scores, done, portion, least = np.zeros(n, np.int64), 0, 4, 1
    after = np.append(grid[1:], n)
    while done < len(stretch) and bound[stretch[done]] >= least:
        now = stretch[done : done + portion]
        now = now[bound[now] >= least]
        done, portion = done + len(now), portion * 2
        inside = np.zeros(n, bool)
        for a, b in zip(grid[now].tolist(), after[now].tolist()):
            inside[a:b] = True
        for (w, places, impact, ends, _), at in zip(terms, block):
            wanted = np.unique(at[now])
            wanted = wanted[wanted < len(ends)]
            if not len(wanted):
                continue
            begin = np.where(wanted > 0, ends[wanted - 1], 0)
            size = ends[wanted] - begin
            where = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            hit = where[inside[places[where]]]
            scores[places[hit]] += w * impact[hit]
        if np.count_nonzero(scores) >= k:
            least = max(1, int(np.partition(scores, n - k)[n - k]))
    found = np.flatnonzero(scores >= least)
    order = np.lexsort((found, -scores[found]))[:k]
    return found[order], scores[found[order]]


def _searcher(items: list[tuple[int, dict[str, int]]], k: int):
    def run(table: pa.Table) -> pa.Table:
        lists = Lists(table)
        number, ids, scores = [], [], []
        for item, query in items:
            places, got = best(lists, query, k)
            number += [item] * len(places)
            ids.append(lists.doc_ids.take(pa.array(places)) if len(places) else pa.array([], pa.int64()))
            scores.append(got)
        return pa.table({"item": pa.array(number, pa.int32()), "doc_id": pa.concat_arrays(ids or [pa.array([], pa.int64())]), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0, np.int64), pa.int64())})

    return run


def search(index: DataFrame, items: list[dict[str, int]], k: int = TOP) -> DataFrame:
    """item (its number), doc_id, score of each item's k best documents of every
    shard. items: weights by term, repeats multiplied in."""
    spark = index.sparkSession
    ship(spark)
    wanted = sorted({t for q in items for t in q})
    terms = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string"))  # of at most ITEMS items
    lists = index.join(terms, "term", "left_semi").unionByName(index.where("term is null"))
    sent = spark.sparkContext.broadcast(list(enumerate(items)))

    def run(table: pa.Table) -> pa.Table:
        return _searcher(sent.value, k)(table)

    return lists.groupBy("shard").applyInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs(doc_id, text) for each of
    items(item_id, text)."""
    spark = docs.sparkSession
    items, _ = stash(items.select("item_id", "text").distinct(), spark, "items")
    portions = max(1, -(-items.count() // ITEMS))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(portions))
    words = counted(items.select(F.lit(0).alias("doc_id"), "text")).select(F.explode("terms").alias("term")).distinct()
    held = words.limit(VOCABULARY + 1).collect()
    vocabulary = frozenset(r["term"].encode() for r in held) if len(held) <= VOCABULARY else None
    rows, _ = stash(counted(docs, vocabulary), spark, "terms")
    n_docs, length = statistics(rows)
    weight, _ = stash(weights(rows, n_docs).join(words, "term", "left_semi"), spark, "weights")
    index, _ = stash(build_index(rows, n_docs, length), spark, "index")
    out = []
    for p in range(portions):  # each portion is bounded, and so is what is sent of it
        mine = [(r["item_id"], Counter(t.decode() for t in terms_of(r["text"]))) for r in items.where(of == p).collect()]
        asked = spark.createDataFrame([(t,) for t in sorted({t for _, q in mine for t in q})], "term string")
        w = {r["term"]: r["weight"] for r in weight.join(F.broadcast(asked), "term", "left_semi").collect()}
        found = search(index, [{t: c * w[t] for t, c in q.items() if t in w} for _, q in mine], k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(mine)], f"item int, item_id {dict(items.dtypes)['item_id']}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out.append(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the ten best of all documents for each benchmark item."""
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS terms FROM documents WHERE text IS NOT NULL),
  s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
  q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))) GROUP BY ALL),
  p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
  x AS (SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) AS impact FROM p, s),
  r AS (SELECT item, item_id, row, doc_id, sum(times * w.w * impact)::BIGINT AS score FROM q JOIN w USING (term) JOIN x USING (term) GROUP BY ALL)
  SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""

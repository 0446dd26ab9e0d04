"""Benchmark decontamination with a positional inverted index, in Spark SQL only.

1. Test windows (N words of an item; a shorter item is one window) and the
   occurrences of every test term in all training texts are counted. The terms of
   a window are ranked from the rarest on; a window with a term that no text has
   is out.
2. The index stores postings (term, document, position) of training tokens, sorted
   by term within each segment (file). Only postings near (within N - 1 words of)
   an occurrence of some window's rarest term can take part in a match, so only
   those of test terms there are stored.
3. The list of a window's rarest term, shifted by its offset, gives candidate
   starts; the list of its next-rarest term, shifted likewise, is intersected with
   them, and what is left is intersected with the lists of all other terms. What
   all lists agree on is an exact phrase. `nearby` intersects by distance instead:
   places of the rarest term around which a share of the window's terms stands.

Joins of lists are by (document, term, position), so a frequent term or a long
text is spread like any other. Terms and windows of the benchmark are broadcast
while they are fewer than MAX_BROADCAST_ROWS and joined by key beyond that.

Defined cases: null or wordless texts have no words and no hits (not
contaminated); null item ids take part in hits but cannot be listed; equal items
or repeated rows count once per item_id; rows that share a doc_id are judged one
by one by their own text; empty tables give empty results; extra columns are
ignored by the query and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read, stash

N = 13
MAX_BROADCAST_ROWS = 200_000
#: More terms than any window has.
N_MAX = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; empty for null."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN, -1), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """k1, k2: 128 bits of a row's id and text, which stand for the row."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"))


def windows_of(items: DataFrame, n: int = N) -> DataFrame:
    """item_id, window (array of words), one row for each window."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    return words.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), F.lit(n)).alias("window"))


def _wid(window: str) -> Column:
    """16 bytes that stand for a window (no word holds a blank)."""
    return F.unhex(F.substring(F.sha2(F.concat_ws(" ", window), 256), 1, 32))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def ranked(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """wid, terms of each distinct window: (n, term, off) from the rarest on.
    Windows with a term that no text has are left out."""
    spark = docs.sparkSession
    terms = windows.select(F.explode("window").alias("term")).distinct()
    found = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    counts, at_counts = stash(found.join(_small(terms), "term").groupBy("term").agg(F.count("*").alias("n")), spark, "counts")
    each = windows.select("wid", "window").distinct().select("wid", F.posexplode("window").alias("off", "term")).join(_small(counts), "term", "left")
    lists = each.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "off"))).alias("terms"))  # N terms
    out, _ = stash(lists.where(F.col("terms")[0]["n"] > 0), spark, "windows")
    drop(spark, at_counts)
    return out


def build_index(docs: DataFrame, windows: DataFrame, n: int = N) -> DataFrame:
    """Postings term, k1, k2, pos of test terms near rarest terms of windows."""
    words = _keyed(docs).select("k1", "k2", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    anchors = _small(windows.select(F.col("terms")[0]["term"].alias("term")).distinct())
    terms = _small(windows.select(F.explode("terms.term").alias("term")).distinct())
    places = words.select("k1", "k2", "words", F.posexplode("words").alias("at", "term")).join(anchors, "term")
    first = F.greatest(F.col("at") - (n - 1), F.lit(0))
    around = places.select("k1", "k2", first.alias("first"), F.posexplode(F.slice("words", first + 1, F.col("at") - first + n)).alias("i", "term"))
    postings = around.join(terms, "term").select("term", "k1", "k2", (F.col("first") + F.col("i")).alias("pos")).distinct()
    return postings.sortWithinPartitions("term", "k1", "k2", "pos")


def _starts(index: DataFrame, windows: DataFrame) -> DataFrame:
    """wid, k1, k2, start: the rarest terms' lists shifted by their offsets."""
    rarest = windows.select("wid", F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["off"].alias("off"))
    return index.join(_small(rarest), "term").select("wid", "k1", "k2", (F.col("pos") - F.col("off")).alias("start"))


def phrases(index: DataFrame, windows: DataFrame) -> DataFrame:
    """k1, k2, wid, start, end: exact occurrences of windows."""
    spark = index.sparkSession
    starts = _starts(index, windows).where("start >= 0")
    second = windows.where(F.size("terms") > 1).select("wid", F.col("terms")[1]["term"].alias("term"), F.col("terms")[1]["off"].alias("off"))
    two = starts.join(_small(second), "wid").select("wid", "k1", "k2", "start", "term", (F.col("start") + F.col("off")).alias("pos"))
    two, _ = stash(two.join(index, ["k1", "k2", "term", "pos"]).select("wid", "k1", "k2", "start"), spark, "two")
    rest = windows.where(F.size("terms") > 2).select("wid", F.size("terms").alias("n"), F.explode(F.slice("terms", 3, N_MAX)).alias("t"))
    wanted = two.join(_small(rest), "wid").select("wid", "k1", "k2", "start", "n", F.col("t.term").alias("term"), (F.col("start") + F.col("t.off")).alias("pos"))
    all_lists = wanted.join(index, ["k1", "k2", "term", "pos"]).groupBy("wid", "k1", "k2", "start").agg(F.count("*").alias("met"), F.max("n").alias("n"))
    of_size = windows.select("wid", F.size("terms").alias("n"))
    found = [
        all_lists.where("met = n - 2").select("wid", "k1", "k2", "start", "n"),
        two.join(_small(of_size.where("n = 2")), "wid").select("wid", "k1", "k2", "start", "n"),
        starts.join(_small(of_size.where("n = 1")), "wid").select("wid", "k1", "k2", "start", "n"),
    ]
    whole = found[0].unionByName(found[1]).unionByName(found[2])
    return whole.select("k1", "k2", "wid", "start", (F.col("start") + F.col("n")).alias("end"))


def nearby(index: DataFrame, windows: DataFrame, share: float, n: int = N) -> DataFrame:
    """k1, k2, wid, at, near: places `at` of a window's rarest term within n - 1
    words of which at least this share of the window's distinct terms stands, and
    how many stand there."""
    rarest = windows.select("wid", F.col("terms")[0]["term"].alias("term"))
    places = index.join(_small(rarest), "term").select("wid", "k1", "k2", F.col("pos").alias("at"))
    distinct = windows.select("wid", F.array_distinct("terms.term").alias("own"))
    wanted = places.join(_small(distinct), "wid").select("wid", "k1", "k2", "at", F.size("own").alias("n"), F.explode("own").alias("term"))
    within = wanted.join(index, ["k1", "k2", "term"]).where(F.abs(F.col("pos") - F.col("at")) < n)
    counted = within.groupBy("wid", "k1", "k2", "at").agg(F.count_distinct("term").alias("near"), F.max("n").alias("n"))
    return counted.where(F.col("near") >= F.col("n") * share).select("k1", "k2", "wid", "at", "near")


def indexed(docs: DataFrame, items: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows of the items (item_id, wid, window), their ranked terms, and
    the index of docs."""
    spark = docs.sparkSession
    windows, _ = stash(windows_of(items, n).withColumn("wid", _wid("window")).distinct(), spark, "items")
    terms = ranked(docs, windows)
    index, _ = stash(build_index(docs, terms, n), spark, "index")
    return windows, terms, index


def hits(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """k1, k2, n_hit, items of the documents with at least one window."""
    windows, terms, index = indexed(docs, items, n)
    found = phrases(index, terms).join(_small(windows.select("item_id", "wid")), "wid")
    spans = found.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.collect_set("item_id").alias("items")
    )
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("hit"), F.greatest(a["upto"], s["end"]).alias("upto")
        ),
        lambda a: a["hit"],
    )
    return spans.select("k1", "k2", covered.cast("long").alias("n_hit"), "items")


def judged(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated by document."""
    found = hits(docs, items, n)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    per = _keyed(docs).select("doc_id", "k1", "k2", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return per.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(listed, F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """docs without the contaminated ones, all columns kept."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.xxhash64("row.doc_id", "row.text").alias("k1"), F.xxhash64(F.lit(7), "row.text", "row.doc_id").alias("k2")
    )
    found = hits(docs.select("doc_id", "text"), items, n)
    sized = _keyed(docs.select("doc_id", "text")).select("k1", "k2", F.size(words_of(F.col("text"))).alias("n")).join(found, ["k1", "k2"])
    bad = sized.where(F.col("n_hit") * 20 >= F.col("n")).select("k1", "k2").distinct()
    return keyed.join(bad, ["k1", "k2"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over all documents and benchmark items."""
    return judged(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(words, i, i + 12) AS win
       FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, i, n, list_slice(words, i, i + n - 1) AS win
       FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, lens WHERE len(words) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

"""Order MinHash fingerprints, in Spark SQL only.

A text is cut into words (runs without white space, at most MAX_WORD characters
each); a k-mer is K words in a row. Equal k-mers are numbered by occurrence, so
repetition counts. Each of SLOTS sketches has a permutation of its own of all
numbered k-mers, selects the two that come first, puts them back in the order of
the text and hashes that tuple. Moving a passage changes the order of tuples
even where the set of k-mers stays, so the share of equal sketches follows edit
distance rather than set overlap.

All permutations come from one hash. Its top bits deal the k-mers into SLOTS
bins; sketch s takes the bins in the order s ^ (j * STEP[s] mod SLOTS), j = 0, 1,
..., and the k-mers of a bin by the rest of the hash. So one sort serves all
sketches: nearly all find two k-mers in their first bin in texts of some hundred
words, and short texts, whose bins are thin, get a tuple of two all the same.
The order does not depend on the text, so texts of any lengths compare.

Everything happens within a row. The next document is found in
order-preserving shards of doc_id: the first row of each shard is dealt to the
shard before it as well, so one exchange of the texts is enough.

Fingerprint: SLOTS groups of 8 hex digits, all "--------" for a text without
words. Likeness: equal sketches / SLOTS; 1 if both texts have no words. A text
of fewer than K words has one k-mer, all its words; a sketch of a text with one
k-mer hashes that alone.

Defined cases: null text is empty and has an empty sketch everywhere; null
doc_ids come last in descending order; rows with one doc_id are ordered by text
hash; an only row is its own next; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounds, partitions, read, shard_of

K, SLOTS, MAX_WORD = 3, 64, 32
#: A string has less than 2 ** 31 bytes, so at most 2 ** 30 words.
POSITION_BITS = 30
SLOT_BITS = (SLOTS - 1).bit_length()
REST_BITS = 64 - SLOT_BITS
EMPTY = "-" * 8
#: Odd, so that every bin is reached once; and the inverses that number the bins.
STEP = [pow(2 * s + 1, -1, SLOTS) for s in range(SLOTS)]
#: Bins looked through before all are; texts of so few k-mers are sorted anew for each sketch.
NEAR, FEW = 8, 32


def _expr(template: str, **names: str) -> Column:
    """SQL with the fixed numbers and further names put in."""
    fixed = {
        "k1": K - 1, "tail": ", ".join(f"get(_w, i + {j})" for j in range(1, K)), "b": POSITION_BITS, "rb": REST_BITS,
        "low": f"{(1 << POSITION_BITS) - 1}L", "high": f"{-(1 << POSITION_BITS)}L", "rest": f"{(1 << REST_BITS) - 1}L",
        "last": SLOTS - 1, "slots": SLOTS, "half": SLOTS // 2, "few": FEW,
        "step": f"get(array({', '.join(map(str, STEP))}), s)",
        "starts": f"array({', '.join(f'{(s - SLOTS // 2) << REST_BITS}L' for s in range(1, SLOTS))})",
    }
    return F.expr(template.format(**fixed, **names))


def _probed(bins: int) -> str:
    """The first two k-mers of the first so many bins in the order of sketch s."""
    at = "(s ^ ((j * {step}) & {last}))"
    return f"slice(flatten(transform(sequence(0, {bins - 1}), j -> slice(_g, get(_f, {at}) + 2, least(2, get(_f, {at} + 1) - get(_f, {at}) - 1)))), 1, 2)"


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of a text column. The steps are columns of their
    own that a later step uses twice or more, so none is computed within a loop.

    Words are those of WORD_SPLIT; longer runs than MAX_WORD are cut first."""
    keep = df.columns
    spaced = F.when(F.col(text).rlike(rf"\S{{{MAX_WORD + 1}}}"), F.regexp_replace(text, rf"(\S{{{MAX_WORD}}})(?=\S)", "$1 ")).otherwise(F.col(text))
    step = df.select(*keep, F.array_remove(F.split(spaced, r"\s+", -1), "").alias("_w"))
    step = step.select(*keep, "_w", F.size("_w").alias("_n"))
    # (hash of the k-mer: upper bits | position from 1: lower bits), sorted, with a mark (rest 0) where each bin starts
    step = step.select(
        *keep,
        _expr(
            "sort_array(concat(array({first}), {starts}, transform(slice(_w, 1, greatest(_n - {k1}, least(_n, 1))), (w, i) -> (xxhash64(w, {tail}) & {high}) | cast(i + 1 as bigint))))",
            first=f"{-(1 << 62)}L * 2",
        ).alias("_s"),
    )
    step = step.select(
        *keep, "_s", F.size("_s").alias("_n"),
        _expr("filter(sequence(0, size(_s)), j -> j = 0 or j = size(_s) or shiftright(get(_s, j), {b}) <> shiftright(get(_s, j - 1), {b}))").alias("_r"),
    )
    # occurrence numbers: the place in a run of equal k-mers; later ones get a hash of their own
    runs = _expr(
        "flatten(transform(slice(_r, 1, size(_r) - 1), (a, m) -> transform(slice(_s, a + 1, get(_r, m + 1) - a), (x, o) -> if(o = 0, x, (xxhash64(shiftright(x, {b}), o) & {high}) | (x & {low})))))"
    )
    step = step.select(*keep, "_n", F.when(F.size("_r") == F.col("_n") + 1, F.col("_s")).otherwise(F.sort_array(runs)).alias("_g"))
    step = step.select(*keep, "_n", "_g", _expr("concat(filter(sequence(0, _n - 1), j -> (get(_g, j) & {rest}) = 0), array(_n))").alias("_f"))
    step = step.select(*keep, "_n", "_g", "_f", _expr("if(_n - {slots} <= {few}, filter(_g, x -> (x & {rest}) <> 0), null)").alias("_e"))
    # a few k-mers: their bins renumbered in the order of the sketch, sorted, and the first two named as before
    renumbered = "shiftleft((((shiftright(x, {rb}) + {half}) ^ s) * (2 * s + 1) & {last}) - {half}, {rb}) | (x & {rest})"
    named = "shiftleft(((((shiftright(y, {rb}) + {half}) * {step}) & {last}) ^ s) - {half}, {rb}) | (y & {rest})"
    few = f"transform(sequence(0, {{last}}), s -> transform(slice(sort_array(transform(_e, x -> {renumbered})), 1, 2), y -> {named}))"
    many = f"transform(sequence(0, {{last}}), s -> if(get(_f, s + 1) - get(_f, s) > 2, slice(_g, get(_f, s) + 2, 2), {_probed(NEAR)}))"
    step = step.select(*keep, "_n", "_g", "_f", _expr(f"case when size(_e) <= 2 then array_repeat(_e, {{slots}}) when _e is not null then {few} else {many} end").alias("_p"))
    step = step.select(*keep, "_n", _expr(f"transform(_p, (p, s) -> if(size(p) = 2 or _n - {{slots}} < 2, p, {_probed(SLOTS)}))").alias("_p"))
    a, b = "shiftright(get(p, 0), {b})", "shiftright(get(p, 1), {b})"
    value = f"if((get(p, 0) & {{low}}) > (get(p, 1) & {{low}}), xxhash64({b}, {a}), xxhash64({a}, {b}))"
    cells = _expr(f"array_join(transform(_p, p -> lpad(lower(hex({value} & 4294967295L)), 8, '0')), '')")
    return step.select(*keep, F.when(F.col("_n") > SLOTS, cells).otherwise(F.when(F.col("_n") == SLOTS, F.lit(EMPTY * SLOTS))).alias(out))


def likeness(a: str, b: str) -> Column:
    """Equal sketches / SLOTS, from two fingerprints; 0 if one alone is empty."""
    cell = "substring(cast({c} as binary), 8 * i + 1, 8)"
    equal = F.expr(f"size(filter(sequence(0, {SLOTS - 1}), i -> {cell.format(c=a)} = {cell.format(c=b)}))")
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(equal.cast("double") / SLOTS)


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], made: list[str]) -> DataFrame:
    """doc_id, text, *made and next_text, next_* of the following row in
    descending order of doc_id; after the last row comes the first.

    docs has doc_id and text; derive adds the columns made, after the exchange,
    so they don't travel and big input files are dealt out before the work.
    Shards end at ids that occur, so the first
    row of a shard (in descending order) has its cut as doc_id; it is dealt to
    the shard above as well, and the first row of all to the last shard."""
    cuts = bounds(docs, "doc_id", 8 * partitions(docs.sparkSession))
    tie = F.xxhash64("text")
    ends = docs.agg(F.max("doc_id").alias("hi"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min(F.when(F.col("doc_id").isNull(), tie)).alias("tie")).first()
    first_null = F.col("doc_id").isNull() & (tie == F.lit(ends["tie"]).cast("long"))
    first = first_null if ends["hi"] is None else F.col("doc_id") == ends["hi"]
    own = F.array(*[F.lit(int(c)).cast("long") for c in cuts]) if cuts else F.expr("cast(array() as array<bigint>)")
    top = F.coalesce(F.get(own, F.col("shard")) == F.col("doc_id"), first_null)
    dealt = F.filter(
        F.array(
            F.struct(F.col("shard").alias("at"), F.lit(0).alias("guest")),
            F.when(top, F.struct((F.col("shard") + 1).alias("at"), F.lit(1).alias("guest"))),
            F.when(first, F.struct(F.lit(-1 if ends["nulls"] else 0).alias("at"), F.lit(2).alias("guest"))),
        ),
        lambda x: x.isNotNull(),
    )
    order = Window.partitionBy("at").orderBy((F.col("guest") == 2).asc(), F.col("doc_id").desc_nulls_last(), "tie", "guest")
    rows = docs.select("doc_id", "text", tie.alias("tie"), shard_of(F.col("doc_id"), cuts).alias("shard"))
    rows = derive(rows.select("doc_id", "text", "tie", F.inline(dealt)).repartition("at"))
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in ["text", *made]]
    return rows.select("doc_id", "text", *made, "guest", *nexts).where("guest = 0").drop("guest")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The digest columns of op8 for docs(doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, lambda rows: with_fingerprint(rows, "text", "fingerprint"), ["fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = paired.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over all documents."""
    return fingerprinted(read(spark, sf_dir, "documents"))

"""Personal data by weak supervision, in Spark SQL only.

Spans of four base kinds follow fixed patterns. Weaker shapes are only candidates:
a secret (a long run of mixed letters and digits, or what a credential's name is
set to), a run of digits of a card's length that fails the card's checks, a
national phone number, a spelled-out email address. Three labelers vote -1, 0 or 1
on every span: the regex labeler (shape and checks), the gazetteer labeler (known
top-level domains, area codes, issuers, address ranges, forms of keys) and the
context labeler (words just before the span, credentials' names among them). Expectation-maximisation over the
counts of vote patterns estimates each labeler's reliability for each kind, and
the posteriors train the final span classifier, a logistic model over the votes
and the span's form. It adds candidates it is sure of; base spans always stay.

Only counts of (kind, votes, form) leave the executors: at most a few thousand
rows whatever the corpus. Fitted weights come back as literals.

Positions are found without a parser: the pieces between the matches and the
matches themselves, one after another, make up the text.

Defined cases: null text is empty and has no spans; every row is judged by its
own text, so repeated rows repeat; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stash

# The patterns of the contract, with look-behinds and possessive repeats that
# keep what matches but never scan a run of characters twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+(.)-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SPELLED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z]{2,63})+"
_KEY = "A-Za-z0-9+/_-"
NAMED = r"(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)"
SECRET = (
    rf"(?<![{_KEY}])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[{_KEY}]{{20,}}+={{0,2}}"
    rf"|(?<=[:=\x20\x22'])(?<=[:=]\x20{{0,2}}[\x22']?)(?<=(?i:{NAMED})[\x22']?\x20{{0,2}}[:=]\x20{{0,2}}[\x22']?)[^\s\x22']{{7,}}[^\s\x22'.,;:)]"
    rf"|(?<=\x20)(?<=is\x20)(?<=(?i:{NAMED})\x20is\x20)(?=[^\s\x22'0-9]*+[0-9])[^\s\x22']{{7,}}[^\s\x22'.,;:)]"
)
BASE = ("email", "ip", "card", "phone")
WEAK = ("email_spelled", "phone_local", "card_like", "secret")
#: The base kind whose labelers judge a weaker kind.
LIKE = {"email_spelled": "email", "phone_local": "phone", "card_like": "card"}
SURE = 0.8
#: Matches folded in one go.
CHUNK = 64

# Fixed values of the gazetteer and the context labeler.
#: Generic top-level domains; any two letters count as a country's.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop", "museum", "jobs", "mobi", "travel", "tel", "cat", "asia", "post", "app", "dev", "cloud", "online", "site", "store", "tech", "blog", "shop")
#: Card issuers by their first digits: Visa, Mastercard, American Express,
#: Discover, JCB, Diners Club, UnionPay, Maestro.
ISSUERS = (
    r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|6011|64[4-9]|65|35(?:2[89]|[3-8])|30[0-5]|3[689]|62|5018|5020|5038|5893|6304|6759|676[1-3])"
)
#: Country calling codes.
CALLING = (
    r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
    r"|21[1-368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[0179]|35[0-9]|37[0-8]|38[0-35-79]|42[013]|50[0-9]|59[0-9]|67[02-9]|68[0-35-9]|69[0-2]|800|808|85[02356]|870|878|88[0-36]|96[0-8]|97[0-79]|99[2-68])"
)
#: Area codes of no place, by which a national number is known.
TOLL_FREE = r"^8(?:00|33|44|55|66|77|88)"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|correo|courriel)\W{0,12}(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|login)\W{0,12}(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta)\W{0,12}(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|\btel|call|fax|mobile|telefon|appel|llam)\W{0,12}(?:\w+\W+){0,2}$",
    "secret": rf"(?i){NAMED}(?:[\x22']?\s{{0,2}}[:=]|\sis\s)\s{{0,2}}[\x22']?$",
}
KEY_FORMS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_|sk[-_]|xox[abp]-|AIza|eyJ)"
UUID = r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"
#: Words that stand where a secret would.
PLACEHOLDERS = r"(?i)^(?:required|optional|password|username|undefined|encrypted|protected|incorrect|forgotten|disabled|authentication|authorization|necessary|mandatory|redacted|[*x.<].*)$"
#: What digests look like; so do keys, and only their context tells.
DIGEST = r"(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
AGAINST = r"(?i)(?:version|isbn|order|invoice|serial|article|artikel|page|line|commit|revision|sha-?[0-9]*|md5|checksum|digest|hash|etag|uuid|blob|tree)\W{0,6}$"


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """Array of (gap, word): all matches in order, each with the text since the last."""
    none = F.expr("cast(array() as array<string>)")
    hit = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(possible, F.split(text, pattern, -1)).otherwise(none)
    return F.filter(F.zip_with(gaps, hit, lambda g, w: F.struct(g.alias("gap"), w.alias("word"))), lambda p: p["word"].isNotNull())


def _chunks(pairs: str) -> Column:
    """Matches in chunks, which are folded one by one, so that no array grows
    with the matches of a text. pairs is a column: a loop must not compute it."""
    n = F.size(pairs)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))
    return F.when(n > 0, cut).otherwise(F.expr("cast(array() as array<array<struct<gap:string,word:string>>>)"))


def _placed(chunks: str) -> Column:
    """Array of (start, end, word, before) from a column of chunks."""
    kind = "array<struct<start:int,end:int,word:string,before:string>>"
    long = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, p: a + F.length(p["gap"]) + F.length(p["word"])))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    begins = F.aggregate(long, zero, lambda a, m: F.struct((a["at"] + m).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["word"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["word"].alias("word"), F.right(pair["gap"], F.lit(40)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def fold(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.expr(f"cast(array() as {kind})").alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.zip_with(chunks, begins, fold))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _valid(kind: str, word: Column) -> Column:
    if kind == "ip":
        return word.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        n = F.length(_digits(word))
        return (n >= 16) & (n <= 19) & F.when((n >= 16) & (n <= 19), F.call_function("luhn_check", _digits(word))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(word)).between(8, 15)
    if kind == "card_like":
        return F.length(_digits(word)).between(13, 19) & ~_valid("card", word)
    return F.lit(True)


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["word"])


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id and an array of (start, end, word, before) for each kind."""
    text = F.coalesce("text", F.lit(""))
    digit = text.rlike("[0-9]")
    named = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")) | F.contains(text, F.lit(" is "))) & text.rlike(rf"(?i){NAMED}(?:[\x22']?\x20{{0,2}}[:=]|\x20is\x20)")
    with_text = docs.select("doc_id", text.alias("text"), digit.alias("digit"), named.alias("named"), F.contains(text, F.lit("@")).alias("at"), text.rlike(r"(?i)[\[(]\x20?at\x20?[\])]").alias("spelled"))
    possible = {
        "email": (EMAIL, F.col("at")),
        "ip": (IP, F.col("digit")),
        "card": (CARD, F.col("digit") & F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){15}")),
        "phone": (PHONE, F.col("digit") & F.contains(F.col("text"), F.lit("+"))),
        "email_spelled": (SPELLED_EMAIL, F.col("spelled")),
        "phone_local": (LOCAL_PHONE, F.col("digit")),
        "card_like": (CARD, F.col("digit") & F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "secret": (SECRET, (F.col("digit") & F.col("text").rlike("[0-9][A-Za-z]|[A-Za-z][0-9]")) | F.col("named")),
    }
    found = with_text.select("doc_id", *[_matches(F.col("text"), p, when).alias(k) for k, (p, when) in possible.items()])
    found = found.select("doc_id", *[_chunks(k).alias(k) for k in possible])
    found = found.select("doc_id", *[_placed(k).alias(k) for k in possible])
    found = found.select("doc_id", *[F.filter(k, _passes(k)).alias(k) for k in possible])
    apart = [F.filter(k, lambda s: ~F.exists(F.concat(*BASE), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))).alias(k) for k in WEAK]
    return found.select("doc_id", *BASE, *apart)


def votes(kind: str, span: Column) -> Column:
    """Votes of the labelers and the form of a span, as a struct of ints."""
    base = LIKE.get(kind, kind)
    word, n = span["word"], F.length(_digits(span["word"]))
    shape = F.lit(1 if kind in BASE else 0)
    if base in ("card", "phone", "ip"):
        shape = F.when(F.length(F.regexp_replace(_digits(word), F.substr(_digits(word), F.lit(1), F.lit(1)), F.lit(""))) == 0, -1).otherwise(shape)
    if kind == "card_like":
        shape = F.when(_digits(word).rlike("^(.)\\1*$") | (n >= 16), -1).otherwise(F.when(F.call_function("luhn_check", _digits(word)), 1).otherwise(-1))
    if kind == "secret":
        changes = F.regexp_count(word, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"))
        shape = F.when(word.rlike(DIGEST), 0).when(changes >= 4, 1).when((changes >= 1) | word.rlike("^[A-Za-z]{12,}$"), 0).otherwise(-1)
        gazetteer = F.when(word.rlike(KEY_FORMS), 1).when(word.rlike(UUID) | word.rlike(PLACEHOLDERS), -1).otherwise(0)
    elif base == "email":
        ending = F.lower(F.regexp_extract(word, r"([A-Za-z]+)[\])]?$", 1))
        gazetteer = F.when(ending.isin(*TOP_LEVEL) | (F.length(ending) == 2), 1).otherwise(-1)
    elif base == "card":
        gazetteer = F.when(_digits(word).rlike(ISSUERS), 1).otherwise(-1)
    elif base == "ip":
        gazetteer = F.when(word.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), -1).otherwise(1)
    elif kind == "phone":
        gazetteer = F.when(_digits(word).rlike(CALLING), 1).otherwise(-1)
    else:
        gazetteer = F.when(_digits(word).rlike(TOLL_FREE), 1).when(_digits(word).rlike("^[2-9](?:11|9)|^...(?:[01]|.11)"), -1).otherwise(0)
    context = F.when(span["before"].rlike(CUES[base]), 1).when(span["before"].rlike(AGAINST), -1).otherwise(0)
    return F.struct(
        shape.alias("shape"), gazetteer.alias("gazetteer"), context.alias("context"),
        F.least(F.floor(F.length(word) / 4), F.lit(12)).cast("int").alias("length"), F.least(n, F.lit(20)).cast("int").alias("digits"),
        F.when(span["before"] == "", 0).when(span["before"].rlike(r"\s$"), 1).otherwise(2).alias("left"),
    )


VOTES, FORM = ("shape", "gazetteer", "context"), ("length", "digits", "left")


#: Spans that the start of reliabilities stands for, a share of those seen.
PRIOR = 1.0
#: Where estimates of reliabilities start: P(vote) if the span is of its kind (1)
#: or not (0), for base kinds and for weaker ones, labelers as in VOTES.
START = {
    "base": ({1: {1: 0.6, 0: 0.35, -1: 0.05}, 0: {1: 0.2, 0: 0.4, -1: 0.4}},) * 3,
    "weak": (
        {1: {1: 0.6, 0: 0.35, -1: 0.05}, 0: {1: 0.2, 0: 0.4, -1: 0.4}},
        {1: {1: 0.4, 0: 0.58, -1: 0.02}, 0: {1: 0.05, 0: 0.55, -1: 0.4}},
        {1: {1: 0.7, 0: 0.28, -1: 0.02}, 0: {1: 0.003, 0: 0.497, -1: 0.5}},
    ),
}


def reliabilities(counts: Iterable[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count): the share of true
    spans of each kind and, for each labeler and truth, its vote probabilities.
    Kinds with checks start from a high share. The start also stands for PRIOR
    times the spans seen (20 at least) in every estimate, so votes keep their
    sense, alike at every size: without that, two forms of the same thing can
    pass for the true and the false spans."""
    counts = list(counts)
    kinds = sorted({k for k, _, _ in counts})
    share = {k: 0.9 if k in BASE else 0.5 for k in kinds}
    start = {k: START["base" if k in BASE else "weak"] for k in kinds}
    table = {(k, i, y): dict(start[k][i][y]) for k in kinds for i in range(len(VOTES)) for y in (0, 1)}

    def posterior(k: str, v: tuple[int, ...]) -> float:
        p = [math.log(share[k] if y else 1 - share[k]) + sum(math.log(table[k, i, y][x]) for i, x in enumerate(v)) for y in (0, 1)]
        top = max(p)
        return math.exp(p[1] - top) / sum(math.exp(x - top) for x in p)

    for _ in range(rounds):
        soft = [(k, v, n, posterior(k, v)) for k, v, n in counts]
        for k in kinds:
            own = [(v, n, q) for kind, v, n, q in soft if kind == k]
            total = sum(n for _, n, _ in own)
            prior, held = 0.9 if k in BASE else 0.5, PRIOR * max(total, 20)
            share[k] = (sum(n * q for _, n, q in own) + 10 * prior) / (total + 10)
            for i in range(len(VOTES)):
                for y in (0, 1):
                    weight = {x: held * start[k][i][y][x] + sum(n * (q if y else 1 - q) for v, n, q in own if v[i] == x) for x in (1, 0, -1)}
                    table[k, i, y] = {x: w / sum(weight.values()) for x, w in weight.items()}
    return share, {(k, v): posterior(k, v) for k, v, _ in counts}


def train(rows: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], posteriors: dict, rounds: int = 1500, rate: float = 0.8) -> dict:
    """Weights of a logistic model over (kind), (kind, vote) and (form) marks,
    fitted to the posteriors by gradient descent over the counts. Each kind
    counts as much as any other, however many spans it has, and a pattern of
    votes and form by the root of its number, so rare ones are learned too."""
    total: dict[str, float] = {}
    for k, _, _, n in rows:
        total[k] = total.get(k, 0.0) + math.sqrt(n)
    marked = [marks(k, v, f) for k, v, f, _ in rows]
    number = {m: i for i, m in enumerate(sorted({x for own in marked for x in own}, key=str))}
    x = np.zeros((len(rows), len(number)))
    for i, own in enumerate(marked):
        x[i, [number[m] for m in own]] = 1
    share = np.array([math.sqrt(n) / total[k] / len(total) for k, _, _, n in rows])
    target = np.array([posteriors[k, v] for k, v, _, _ in rows])
    w = np.zeros(len(number))
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w * (1 - 1e-4) - rate * (x.T @ (share * (guess - target)))
    return {m: float(w[i]) for m, i in number.items()}


def marks(kind: str, vote: tuple[int, ...], form: tuple[int, ...]) -> list[tuple]:
    return [("kind", kind), *[(kind, n, v) for n, v in zip(VOTES, vote)], *[(n, v) for n, v in zip(FORM, form)]]


def _score(kind: str, vote: Column, weights: dict) -> Column:
    z = F.lit(weights.get(("kind", kind), 0.0))
    for name, key in [(n, (kind, n)) for n in VOTES] + [(n, (n,)) for n in FORM]:
        own = {k[-1]: w for k, w in weights.items() if k[:-1] == key and isinstance(k[-1], int)}
        for value, w in own.items():
            z = z + F.when(vote[name] == value, F.lit(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def detect(docs: DataFrame, sure: float = SURE, report: Callable[[dict], None] | None = None) -> DataFrame:
    """doc_id, and arrays of (start, end, word, before): base spans by kind, and
    the candidates the classifier is sure of."""
    spark = docs.sparkSession
    spans, _ = stash(spans_of(docs), spark, "spans")
    seen = None
    for kind in BASE + WEAK:
        own = spans.select(F.explode(kind).alias("s")).select(F.lit(kind).alias("kind"), votes(kind, F.col("s")).alias("v")).groupBy("kind", "v").count()
        seen = own if seen is None else seen.unionByName(own)
    rows = [(r["kind"], tuple(r["v"][n] for n in VOTES), tuple(r["v"][n] for n in FORM), r["count"]) for r in seen.collect()]
    if not any(k in WEAK for k, *_ in rows):
        return spans  # nothing to judge
    counts: dict[tuple, int] = {}
    for k, v, _, n in rows:
        counts[k, v] = counts.get((k, v), 0) + n
    share, posteriors = reliabilities((k, v, n) for (k, v), n in sorted(counts.items()))
    weights = train(sorted(rows), posteriors)
    if report:
        report({"share": share, "weights": weights})
    return spans.select("doc_id", *BASE, *[F.filter(k, _believed(k, weights, sure)).alias(k) for k in WEAK])


def _believed(kind: str, weights: dict, sure: float) -> Callable[[Column], Column]:
    return lambda span: _score(kind, votes(kind, span), weights) >= sure


def _name(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _listed(kinds: Iterable[str]) -> Column:
    each = [F.transform(k, _name(k)) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over all documents. n_<kind> counts the spans of a kind, base kinds
    first; n_spans counts all."""
    found = detect(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(BASE), 256).alias("base_sha256"), _listed(BASE + WEAK).alias("spans"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in WEAK], sum(F.size(k) for k in BASE + WEAK).cast("long").alias("n_spans"),
    )

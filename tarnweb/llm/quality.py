"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; unlabelled web text is a
sample of all documents. The class prior is estimated from how the two differ: a
first model tells positives from unlabelled text, and over every upper tail of
its score the share of unlabelled text over the share of positives bounds the
prior from above; the median bound over tails of half to nine tenths of the
positives is taken. A linear model over features of the
whole text then minimises the non-negative unbiased risk
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) with the
logistic loss, so its output is a probability. Negative labels are never used.

The fit takes at most POSITIVES + UNLABELLED documents, chosen by a hash of
doc_id (of rows that share one, the text of least hash); that bounds the sample
of the fit only. Scoring covers every document and never gathers anything.

Defined cases: null and empty texts have all-zero features and get the score the
model gives those; a document with several labels is a trusted positive only if
all say 1; rows with one doc_id are scored one by one; without any positive all
scores are 0.5; null doc_ids are not held out and never used for the fit; an
empty table gives an empty result; extra columns are kept by `accepted`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, read, ship

#: Bounds of the sample the model is fitted on.
POSITIVES, UNLABELLED = 4000, 8000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
SYMBOLS = b"#$%&*|<>{}[]=~^_@\\"
_CLASS = np.zeros(256, np.int64)
for _i in range(256):
    _c = bytes([_i])
    _CLASS[_i] = (
        1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == b"\n" else 5 if _c.isspace() or _i < 32
        else 6 if _c in SYMBOLS and _i < 128 else 7 if _c == b"!" else 8 if _i < 128 else 9
    )
NAMES = (
    "lower", "upper", "digit", "newline", "space", "symbol", "exclaim", "punctuation", "high", "entropy", "words", "word_length", "distinct",
    "repeated", "top_word", "ends_symbol", "all_upper", "bare_symbol", "line_length", "distinct_lines",
)


def features(text: str) -> np.ndarray:
    """Form of a text: shares of character classes, words and lines."""
    out = np.zeros(len(NAMES))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not words:
        return out
    counts = np.bincount(raw, minlength=256)
    out[:9] = np.bincount(_CLASS, weights=counts, minlength=10)[1:] / len(raw)
    p = counts[counts > 0] / len(raw)
    out[9] = -(p * np.log2(p)).sum() / 8
    n = len(words)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    out[10] = math.log1p(n) / 10
    out[11] = min(sum(map(len, words)) / n / 20, 2)
    out[12] = len(seen) / n * min(1.0, math.log1p(n) / 6)
    out[13] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[14] = max(seen.values()) / n if n > 4 else 0.0
    last = [w[-1] for w in words]
    out[15] = sum(c in "#$%&*|!=~^_" for c in last) / n
    out[16] = sum(c for w, c in seen.items() if w.isupper() and len(w) > 1) / n
    out[17] = sum(c for w, c in seen.items() if not any(map(str.isalnum, w))) / n
    lines = text.split("\n")
    out[18] = min(math.log1p(len(text) / len(lines)) / 10, 2)
    out[19] = len(set(lines)) / len(lines)
    return out


def _scaled(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, -6, 6)
    return np.concatenate([z, np.minimum(z * z, 16) / 4, np.ones((len(z), 1))], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = 1500, rate: float = 0.03, decay: float = 1e-3) -> np.ndarray:
    """Adam on the non-negative risk; without a prior, plain positives against
    unlabelled text."""
    w = np.zeros(pos.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = _sigmoid(pos @ w), _sigmoid(unl @ w)
        up = -((1 - sp)[:, None] * pos).mean(0)  # of R+ on positives
        down_p, down_u = (sp[:, None] * pos).mean(0), (su[:, None] * unl).mean(0)
        if prior is None:
            g = up + down_u
        else:
            negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
            g = prior * up + (down_u - prior * down_p) if negative >= 0 else prior * down_p - down_u
        g = g + decay * np.concatenate([w[:-1], [0]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Typical ratio of upper tails that hold half to nine tenths of the
    positives: it is the prior as long as those tails are free of negatives, and
    the median over tails keeps sampling noise from pulling it down."""
    w = _fit(pos, unl, None, steps=400)
    p, u = np.sort(pos @ w), np.sort(unl @ w)
    cuts = np.quantile(p, np.linspace(0.1, 0.5, 41))
    tail_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    tail_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    return float(np.clip(np.median(tail_u / tail_p), 0.05, 0.98))


def train(pos: np.ndarray, unl: np.ndarray) -> dict:
    """The fitted model: centre, scale, weights, prior."""
    if not len(pos) or not len(unl):
        n = len(NAMES)
        return {"centre": np.zeros(n), "scale": np.ones(n), "weights": np.zeros(2 * n + 1), "prior": 0.5}
    centre = np.median(pos, 0)
    scale = np.maximum(pos.std(0), 1e-3) * 2
    p, u = _scaled(pos, centre, scale), _scaled(unl, centre, scale)
    prior = class_prior(p, u)
    return {"centre": centre, "scale": scale, "weights": _fit(p, u, prior), "prior": prior}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t or "").tolist() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("place"), b.column("positive"), pa.array(x, pa.list_(pa.float64()))], names=["place", "positive", "x"])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """Fit on bounded samples of trusted positives and of unlabelled documents,
    neither from the held-out part."""
    ship(docs.sparkSession)
    place = F.xxhash64("doc_id")
    trusted = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1")
    some = trusted.select("doc_id", F.lit(1).alias("positive")).orderBy(place, "doc_id").limit(positives)
    rest = docs.select("doc_id").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).distinct()
    rest = rest.select("doc_id", F.lit(0).alias("positive")).orderBy(F.xxhash64(F.lit("u"), "doc_id"), "doc_id").limit(unlabelled)
    wanted = F.broadcast(some.unionByName(rest))  # at most positives + unlabelled ids
    one = docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id", "positive").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = one.select(place.alias("place"), "positive", "text").mapInArrow(in_slices(_features), "place long, positive int, x array<double>")
    got = sorted((r["positive"], r["place"], tuple(r["x"])) for r in rows.collect())  # at most positives + unlabelled
    x = {y: np.array([r[2] for r in got if r[0] == y]).reshape(-1, len(NAMES)) for y in (0, 1)}
    return train(x[1], x[0])


def scorer(model: dict, column: str = "text", keep_from: float | None = None):
    """Adds score to the rows, or keeps the rows that score so much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "") for t in b.column(b.schema.get_field_index(column)).to_pylist()]).reshape(-1, len(NAMES))
            s = _sigmoid(_scaled(x, model["centre"], model["scale"]) @ model["weights"])
            if keep_from is None:
                yield pa.RecordBatch.from_arrays([*b.columns[:1], pa.nulls(len(b), pa.string()), pa.array(s)], names=[*b.schema.names, "_score"])
            else:
                yield b.filter(pa.array(s >= keep_from))

    return in_slices(run)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects, all columns kept."""
    model = fit(docs.select("doc_id", "text"), labels)
    return docs.mapInArrow(scorer(model, keep_from=threshold), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: doc_id, held_out, score, predicted of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = docs.mapInArrow(scorer(model), "doc_id long, text string, _score double").drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))

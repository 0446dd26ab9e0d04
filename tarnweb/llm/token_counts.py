"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once by the library, which gives the characters where
each token starts and ends. Sections are spans that tile the text; both lists
are sorted, so a binary search of the borders among the tokens joins them, and
only the tokens looked at leave the library. A token that crosses a border belongs, by rule, to the section of
its first character; how many cross is reported.

Sections here are lines, each with the line feed that ends it.

Defined cases: null and empty texts have no token and one empty section; rows
with one doc_id are counted one by one; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_slices, read, ship
from .tokens import portions, whole

VOCABULARY = "byte_bpe_50k.json"
#: Tokens a section from which on borders are searched for; below, all offsets are read. Both give the same.
SPARSE = 32


def line_starts(text: str) -> np.ndarray:
    """Character where each line starts; a last line without text is none."""
    lines = text.splitlines(keepends=True) if _only_line_feeds(text) else [x + "\n" for x in text.split("\n")]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1, np.int64)
    starts = np.cumsum(sizes) - sizes
    return starts[starts < max(len(text), 1)]


def _only_line_feeds(text: str) -> bool:
    return not any(c in text for c in "\r\x0b\x0c\x1c\x1d\x1e\x85  ")


def attribute(token_at: np.ndarray, token_end: np.ndarray, section_at: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a border."""
    section = np.searchsorted(section_at, token_at, "right") - 1
    border = np.concatenate([section_at[1:], [length]])
    return np.bincount(section, minlength=len(section_at)), int((token_end > border[section]).sum())


def search(encoding, section_at: list[int]) -> tuple[list[int], int]:
    """What attribute() gives, asking the encoding for few of its offsets: each
    border is looked for from the border before it on, in doubled steps, then by
    halves. A border lies within one token at most."""
    at, n = encoding.token_to_chars, len(encoding)
    counts, crossing, lo, last = [], 0, 0, -1
    for border in section_at[1:]:
        begin, step = lo, 1
        while lo + step <= n and at(lo + step - 1)[0] < border:
            lo, step = lo + step, 2 * step
        hi = min(lo + step - 1, n)
        while lo < hi:
            middle = (lo + hi) // 2
            if at(middle)[0] < border:
                lo = middle + 1
            else:
                hi = middle
        counts.append(lo - begin)
        if lo > 0 and lo - 1 != last and at(lo - 1)[1] > border:
            crossing, last = crossing + 1, lo - 1
    return [*counts, n - lo], crossing


def _counter(vocabulary: str, sections: Callable[[str], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = whole(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            tokens, number, crossing, per = [], [], [], []
            for lo, hi in portions(texts, 1 << 18):
                for text, e in zip(texts[lo:hi], tokenizer.encode_batch(texts[lo:hi], add_special_tokens=False)):
                    starts = sections(text)
                    if len(starts) * SPARSE <= len(e):
                        counts, crossed = search(e, starts.tolist())
                    else:
                        offsets = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e)).reshape(-1, 2)
                        counts, crossed = attribute(offsets[:, 0], offsets[:, 1], starts, len(text))
                        counts = counts.tolist()
                    tokens.append(len(e))
                    number.append(len(starts))
                    crossing.append(crossed)
                    per.append(",".join(map(str, counts)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in (tokens, number, crossing)], pa.array(per, pa.string())],
                names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )

    return in_slices(run, tokens=True)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, sections: Callable[[str], np.ndarray] = line_starts) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing and the comma-joined number of
    tokens of each section, for docs(doc_id, text)."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _counter(vocabulary, sections), "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over all documents."""
    return count_tokens(read(spark, sf_dir, "documents"))

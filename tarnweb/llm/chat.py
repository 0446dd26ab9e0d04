"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn by turn, with three markers that are
single tokens. Control strings inside texts and roles are escaped reversibly, so
markers occur only where the template puts them. The rendering is encoded once
with character offsets; turn spans and token spans are both sorted, and a binary
search finds the tokens of each assistant text. As markers are tokens of their
own, no token crosses the border of a turn.

Rows are dealt by conv_id and sorted by turn; a task streams one conversation at
a time. A conversation is one row of the output, so it is the unit of memory.

Defined cases: null text and null role are empty; rows of null conv_id are one
conversation; turns sort with nulls first, ties by role and text, and repeated
rows stay; a turn without text has an empty span; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, read, ship, stash

VOCABULARY, LEARNED_ROLE = "byte_bpe_50k.json", "assistant"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learned: str = LEARNED_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the learned role's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        parts += [head, body, END]
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, text = part.split(TEXT, 1)
        turns.append((unescape(role), unescape(text[: -len(END)])))
    return turns


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie within the spans; all three are sorted."""
    out = np.zeros(len(starts), bool)
    for a, b in spans:
        if b > a:
            out[np.searchsorted(starts, a, "left") : np.searchsorted(ends, b, "right")] = True
    return out


_TOKENIZERS: dict = {}


def tokenizer(name: str):
    if name not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (TURN, TEXT, END)])
        _TOKENIZERS[name] = t
    return _TOKENIZERS[name]


FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def _formatter(vocabulary: str, learned: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        rows = itertools.chain.from_iterable(zip(*[b.column(n).to_pylist() for n in ("conv_id", "role", "text")]) for b in batches)
        for conv, turns in itertools.groupby(rows, key=lambda r: r[0]):
            formatted, spans = render([(r or "", x or "") for _, r, x in turns], learned)
            e = t.encode(formatted, add_special_tokens=False)
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict(
                {"conv_id": [conv], "formatted": [formatted], "ids": [e.ids], "starts": [offsets[:, 0]], "ends": [offsets[:, 1]], "mask": [mask(offsets[:, 0], offsets[:, 1], spans)]},
                schema=_SCHEMA,
            )

    return in_slices(run)


_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))]
)


def format_conversations(rows: DataFrame, vocabulary: str = VOCABULARY, learned: str = LEARNED_ROLE) -> DataFrame:
    """conv_id, formatted, ids, starts, ends, mask for conv_id, turn, role, text."""
    ship(rows.sparkSession)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatter(vocabulary, learned), FORMATTED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for conv, text, starts, ends, learned in zip(*[b.column(n).to_pylist() for n in ("conv_id", "formatted", "starts", "ends", "mask")]):
            turns = parse(text)
            pieces: list[list[int]] = []
            for s, e, m in zip(starts, ends, learned):
                if m and pieces and s <= pieces[-1][1]:
                    pieces[-1][1] = max(pieces[-1][1], e)
                elif m:
                    pieces.append([s, e])
            loss = "".join(unescape(text[s:e]) for s, e in pieces)
            raw = "".join(f"{r}\n{x}\n" for r, x in turns)
            sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (raw, loss)]
            out.append((conv, len(turns), sha[0], len(loss), sha[1], len(text)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted output holds, from its text, offsets and masks."""
    return formatted.mapInArrow(in_slices(_digests, rows=64), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all conversations and conversation -7, written, read back, digested."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    written, _ = stash(format_conversations(rows), spark, "chat")
    return digests(written)

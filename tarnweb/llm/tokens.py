"""Cached tokenisation on top of the ``tokenizers`` library.

The tokenizers used here never build a token across certain places of a text:
white space for word-level vocabularies, pre-token borders for byte-level ones.
A text is cut at such places, each distinct piece is encoded once by the library
itself, and the ids of a document are gathered from the table of pieces with
numpy. The result is what encoding the whole text gives; a text for which the
cut is not certain to agree goes to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: Pre-token pattern of byte-level vocabularies (a fixed value of the format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that regular-expression engines do not agree on as white space,
#: and the start of a special token's string.
DOUBTFUL = r"[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]|<\|"
#: Word-level vocabularies: in a text of these characters alone a token ends
#: wherever letters and other characters meet. (The quote starts tokens as 's.)
#: U+0130 is left out: in lower case it is a letter and a mark, two tokens.
PLAIN = r"[\x00-&(-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u00ab\u00bb\u00bf\u00a1]*"
LETTERS = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
RUNS = LETTERS + "|" + LETTERS.replace("[", "[^ \n")
#: Pieces kept in a worker, about 170 bytes each. Beyond that the table goes on
#: with the half used most.
MAX_PIECES = 400_000


class _Index(dict):
    """Piece -> number; a new piece gets the next number and is noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Pieces:
    """Ids of the tokens of each distinct piece."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.words = "word_bpe" in os.path.basename(path)
        self.split = regex.compile(BYTE_LEVEL).findall
        self.doubtful = regex.compile(DOUBTFUL).search
        self.plain, self.letters, self.runs = re.compile(PLAIN).fullmatch, re.compile(LETTERS).fullmatch, re.compile(RUNS).findall
        if self.words:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.count, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.used = self.known = 0

    def shrink(self) -> None:
        """Keep the half of the pieces used most, in their order."""
        often = np.sort(np.argsort(-self.uses[: self.known], kind="stable")[: self.known // 2])
        names, ids, start, count, uses = list(self.index), self.ids, self.start[often], self.count[often], self.uses[often]
        kept = [names[i] for i in often.tolist()]
        self.clear()
        where = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        self._add(ids[where], count)
        self.uses[: self.known] = uses // 2
        self.index.update(zip(kept, range(len(kept))))

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(counts) > len(self.start):
            self.start, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.uses))
        new = slice(self.known, self.known + len(counts))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        self.used += len(ids)
        self.known += len(counts)

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces; they keep the order in which they got numbers."""
        if self.words:
            self._add(*self._runs(pieces))
            return
        got = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        self._add(np.array([i for e in got for i in e.ids], np.uint32), np.array([len(e.ids) for e in got], np.int64))

    def _runs(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces. A run of letters is one pre-token, whose last token
        is marked, so all runs of letters go through one call."""
        together, alone = [], []
        for p in pieces:
            (together if self.letters(p) else alone).append(p)
        found = {}
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(together)], add_special_tokens=False)[0].ids, np.uint32)
        last = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
        if len(last) != len(together):  # a letter that the library takes apart
            together, alone = [], pieces
        for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            found[p] = np.array(e.ids, np.uint32).tobytes()
        if together:
            raw, begin = ids.tobytes(), 0
            for p, end in zip(together, last):
                found[p] = raw[begin:end]
                begin = end
        parts = [found[p] for p in pieces]
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        return np.frombuffer(b"".join(parts), np.uint32), counts

    def cut(self, text: str) -> list[str]:
        if self.words:
            if self.plain(text) and "<|" not in text:
                return self.runs(text)
            return text.replace("\n", " ").split(" ")
        return [text] if self.doubtful(text) else self.split(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if self.known > MAX_PIECES:
            self.shrink()
        cut = [self.cut(t) for t in texts]
        per = np.fromiter(map(len, cut), np.int64, len(cut))
        piece = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(per.sum()))
        for i in range(0, len(self.index.new), 4096):
            self._learn(self.index.new[i : i + 4096])
        self.index.new.clear()
        self.uses[: self.known] += np.bincount(piece, minlength=self.known)
        count = self.count[piece]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.start[piece] - (ends - count), count) + np.arange(total)
        first = np.concatenate([[0], np.cumsum(per)])
        edge = np.concatenate([[0], ends])[first]
        return self.ids[where], np.diff(edge)


_LOADED: dict[str, Pieces] = {}


def pieces(name: str) -> Pieces:
    """One table a worker process and vocabulary."""
    if name not in _LOADED:
        _LOADED[name] = Pieces(name)
    return _LOADED[name]


def whole(name: str):
    """The library's tokenizer itself, one a worker process and vocabulary."""
    return pieces(name).tokenizer


def release() -> None:
    """Drop the tables of this worker: it goes on with another operator."""
    _LOADED.clear()


def portions(texts: list[str], chars: int = 1 << 20):
    """Index ranges of about so many characters, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)

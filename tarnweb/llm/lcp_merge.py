"""Sorted suffix runs: front coding and merging that knows common prefixes.

Keys are the first K bytes of suffixes. A run is sorted and front-coded: each
key is stored as the length of the prefix it shares with the key before it and
the rest. Runs are merged by a loser tree whose players carry the length of the
prefix they share with the last winner: of two players the one that shares more
is the smaller, and only if both share as much are bytes compared, from there
on. A front-coded run hands its next key over with that length already known.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

K = 32


def sort_run(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of an (n, K) byte array and, in that order, the length
    of the prefix that each shares with the row before."""
    columns = keys.view(">u8").astype(np.uint64)
    order = np.lexsort(columns.T[::-1])
    ordered = keys[order]
    differs = ordered[1:] != ordered[:-1]
    shared = np.where(differs.any(1), differs.argmax(1), K) if len(differs) else np.zeros(0, np.int64)
    return order, np.concatenate([[0], shared])[: len(order)].astype(np.uint8)


def pack(keys: np.ndarray, shared: np.ndarray, refs: np.ndarray, texts: list[bytes]) -> bytes:
    """A block of sorted keys (equal ones stand once, with all their places).
    refs: (n, 2) text number and position; texts: 16-byte ids of the texts."""
    used, number = np.unique(refs[:, 0], return_inverse=True)
    shared = shared.copy()
    shared[0] = 0
    first = np.flatnonzero(shared < K)
    counts = np.diff(np.concatenate([first, [len(keys)]]))
    tails = keys[first][np.arange(K) >= shared[first][:, None]]
    head = struct.pack("<IIII", len(first), len(keys), len(used), len(tails))
    return b"".join(
        [head, shared[first].tobytes(), counts.astype("<u4").tobytes(), number.astype("<u4").tobytes(), refs[:, 1].astype("<u4").tobytes(), tails.tobytes(), *[texts[i] for i in used]]
    )


class Run:
    """A packed block, read key by key."""

    def __init__(self, block: bytes):
        n, total, texts, tail = struct.unpack_from("<IIII", block)
        at = 16
        self.shared = list(block[at : at + n])
        at += n
        self.counts = np.frombuffer(block, "<u4", n, at).tolist()
        at += 4 * n
        self.text = np.frombuffer(block, "<u4", total, at)
        self.place = np.frombuffer(block, "<u4", total, at + 4 * total)
        at += 8 * total
        self.tails = block[at : at + tail]
        self.ids = [block[at + tail + 16 * i : at + tail + 16 * i + 16] for i in range(texts)]

    def __iter__(self) -> Iterator[tuple[int, bytes, int, int]]:
        key, at, ref = b"", 0, 0
        for shared, count in zip(self.shared, self.counts):
            end = at + K - shared
            key = key[:shared] + self.tails[at:end]
            yield shared, key, ref, count
            at, ref = end, ref + count


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, int]]:
    """(prefix shared with the key before, run, first ref, refs) in key order."""
    k = len(runs)
    heads = [iter(r) for r in runs]
    known, key, ref, count = [0] * k, [None] * k, [0] * k, [0] * k

    def advance(i: int) -> None:
        known[i], key[i], ref[i], count[i] = next(heads[i], (0, None, 0, 0))

    def beats(a: int, b: int) -> bool:
        """Whether a comes first; the loser's known prefix becomes that with the winner."""
        x, y = key[a], key[b]
        if x is None or y is None:
            return y is None
        i, j = known[a], known[b]
        if i != j:
            return i > j
        while i < K and x[i] == y[i]:
            i += 1
        if i == K or x[i] < y[i]:
            known[b] = i
            return True
        known[a] = i
        return False

    for i in range(k):
        advance(i)
    losers = [0] * k  # inner nodes 1 .. k - 1 of a tree whose leaves are k .. 2k - 1
    winner = [0] * (2 * k)
    for i in range(k):
        winner[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while key[top] is not None:
        yield known[top], top, ref[top], count[top]
        advance(top)
        node = (k + top) >> 1
        while node:
            other = losers[node]
            if not beats(top, other):
                losers[node], top = top, other
            node >>= 1


def ranges(ordered: np.ndarray, splitters: list[bytes]) -> list[int]:
    """Where each splitter falls among sorted keys."""
    rows = [0]
    view = _Rows(ordered)
    for s in splitters:
        rows.append(bisect_left(view, s, rows[-1]))
    return [*rows, len(ordered)]


class _Rows:
    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __len__(self) -> int:
        return len(self.keys)

    def __getitem__(self, i: int) -> bytes:
        return self.keys[i].tobytes()

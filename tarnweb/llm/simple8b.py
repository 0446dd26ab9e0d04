"""Simple-8b word-aligned coding of unsigned integers, vectorised.

A 64-bit word holds a 4-bit selector and 60 bits of data. Selectors 1 to 14 pack
60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 values of 60 // count bits, the
first value lowest. Selector 0 is the escape: the next word is one value of up
to 64 bits as it is. Values are cut in blocks of BLOCK; each block is coded on
its own, so a table of word offsets lets a reader start at any block.

Record: uint32 magic, number of values, block size, number of blocks; uint32
first word of each block; (padding to 8 bytes;) the words. All little-endian.
"""

from __future__ import annotations

import numpy as np

#: Values of the coding (selectors 1 to 14).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK, MAGIC = 256, 0x38424954
U = np.uint64


def _selectors(values: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Selector of the most values that may share a word from each place on.
    room: values left in the block, as bytes (255 for more). Selectors take more
    values of fewer bits as they fall, so the first that fits nowhere ends it."""
    n = len(values)
    width = np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # bit lengths; exact below 2**53, never too low above
    best = np.where(width > 60, 0, 14).astype(np.uint8)
    widest, taken = width.copy(), 1
    for s in range(13, 0, -1):
        count = int(COUNTS[s])
        while taken < count:
            np.maximum(widest[: n - taken], width[taken:], out=widest[: n - taken])
            taken += 1
        fits = (widest <= WIDTHS[s]) & (room >= count)
        if not fits.any():
            break
        best[fits] = s
    return best


def encode(values: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """A record for each run of values; lengths: values in each run."""
    values = np.ascontiguousarray(values, U)
    n = len(values)
    blocks = -(-lengths // BLOCK)
    run_start = np.cumsum(lengths) - lengths
    first = np.repeat(run_start, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    ends = np.minimum(first + BLOCK, np.repeat(run_start + lengths, blocks))
    room = np.minimum(np.repeat(ends, ends - first) - np.arange(n), 255).astype(np.uint8)
    best = _selectors(values, room)
    begins = np.zeros(n + 1, bool)
    at, stop = first.copy(), ends
    while len(at):  # all blocks advance by one word a turn
        begins[at] = True
        at = at + COUNTS[best[at]]
        going = at < stop
        at, stop = at[going], stop[going]
    starts = np.flatnonzero(begins[:n])
    chosen = best[starts]
    words_each = np.where(chosen == 0, 2, 1)
    word_at = np.cumsum(words_each) - words_each
    words = np.zeros(int(words_each.sum()), U)
    for s in np.unique(chosen):
        pick = np.flatnonzero(chosen == s)
        if s == 0:
            words[word_at[pick] + 1] = values[starts[pick]]
            continue
        packed = np.full(len(pick), U(int(s) << 60), U)
        for j in range(int(COUNTS[s])):
            packed |= values[starts[pick] + j] << U(j * int(WIDTHS[s]))
        words[word_at[pick]] = packed
    word_of = np.concatenate([word_at, [len(words)]])
    block_word = word_of[np.searchsorted(starts, first)] if len(first) else np.zeros(0, np.int64)
    run_block = np.concatenate([[0], np.cumsum(blocks)])
    block_word = np.concatenate([block_word, [len(words)]])
    out = []
    for i, length in enumerate(lengths.tolist()):
        a, b = run_block[i], run_block[i + 1]
        lo, hi = int(block_word[a]), int(block_word[b])
        head = np.empty(4 + (b - a) + (b - a) % 2, "<u4")
        head[:4] = MAGIC, length, BLOCK, b - a
        head[4 : 4 + b - a] = block_word[a:b] - lo
        head[4 + b - a :] = 0
        out.append(head.tobytes() + words[lo:hi].astype("<u8").tobytes())
    return out


def _words(record: bytes) -> tuple[int, np.ndarray]:
    magic, n, _, blocks = np.frombuffer(record, "<u4", 4)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b record")
    return int(n), np.frombuffer(record, "<u8", offset=16 + 4 * int(blocks + blocks % 2))


def _with_escapes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selector of each word in order, with -1 for the raw word after an escape."""
    chosen = (words >> U(60)).astype(np.int64)
    i, zero = 0, np.flatnonzero(chosen == 0)
    while True:
        k = np.searchsorted(zero, i)
        if k == len(zero):
            return chosen, words
        i = int(zero[k])
        chosen[i + 1] = -1
        i += 2


def decode(records: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(values of all records, number of values of each)."""
    parts = [_words(r) for r in records]
    lengths = np.array([n for n, _ in parts], np.int64)
    words = np.concatenate([w for _, w in parts]) if parts else np.zeros(0, U)
    chosen = (words >> U(60)).astype(np.int64)
    if (chosen == 0).any():
        split = [_with_escapes(w)[0] for _, w in parts]
        chosen = np.concatenate(split)
    counts = np.where(chosen > 0, COUNTS[np.maximum(chosen, 0)], np.where(chosen == -1, 1, 0))
    at = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), U)
    for s in np.unique(chosen):
        pick = np.flatnonzero(chosen == s)
        if s == -1:
            out[at[pick]] = words[pick]
        elif s > 0:
            mask = U((1 << int(WIDTHS[s])) - 1)
            for j in range(int(COUNTS[s])):
                out[at[pick] + j] = (words[pick] >> U(j * int(WIDTHS[s]))) & mask
    return out, lengths

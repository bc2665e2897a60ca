"""Simple-8b coding of integer arrays, in whole-array numpy steps.

A 64-bit word holds a 4-bit selector and 60 bits for n values of 60 // n bits each; the coder takes the
largest n that fits. A value beyond 60 bits is an escape: a word with selector 15, then the value itself.
Values are cut into blocks of ``BLOCK``; no word spans two blocks and the word offset of every block is
kept, so all blocks advance together while coding and any of them decodes alone.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the code: selector s holds COUNTS[s] values of WIDTHS[s] bits.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE = 15
BLOCK = 1024
_TAIL = max(COUNTS)
_CLASS = np.array([next((i for i, w in enumerate(WIDTHS) if bits <= w), len(WIDTHS)) for bits in range(66)], np.uint8)


def _selectors(flat: np.ndarray) -> np.ndarray:
    """Best selector at every place, from sliding maxima of width classes over n places."""
    n = len(flat)
    sliding = {1: flat}
    best = np.where(flat <= len(WIDTHS) - 1, len(WIDTHS) - 1, ESCAPE).astype(np.uint8)
    for count in sorted(COUNTS)[1:]:
        # two windows already known that cover this one
        part = max(p for p in sliding if p < count)
        other = min(p for p in sliding if p + part >= count)
        shift = count - other
        m = np.full(n, 255, np.uint8)
        m[: n - count] = np.maximum(sliding[part][: n - count], sliding[other][shift : n - count + shift])
        sliding[count] = m
        selector = COUNTS.index(count)
        best[m <= selector] = selector
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block) of an array of unsigned integers."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks, stride = -(-n // BLOCK), BLOCK + _TAIL
    bits = np.frexp(values.astype(np.float64))[1]
    classes = np.full((blocks, stride), 255, np.uint8)
    padded = np.zeros((blocks, stride), np.uint64)
    whole = n // BLOCK
    classes[:whole, :BLOCK] = _CLASS[bits[: whole * BLOCK]].reshape(whole, BLOCK)
    padded[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        classes[whole, : n - whole * BLOCK] = _CLASS[bits[whole * BLOCK :]]
        padded[whole, : n - whole * BLOCK] = values[whole * BLOCK :]
    classes, padded = classes.reshape(-1), padded.reshape(-1)
    best = _selectors(classes)
    steps = np.ones(16, np.int64)
    steps[: len(COUNTS)] = COUNTS
    begins = np.zeros(len(classes), bool)
    ends = np.arange(blocks) * stride + np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    at = np.arange(blocks) * stride
    while len(at):
        begins[at] = True
        at = at + steps[best[at]]
        open_ = at < ends
        at, ends = at[open_], ends[open_]
    places = np.flatnonzero(begins)
    chosen = best[places]
    size = np.where(chosen == ESCAPE, 2, 1)
    to = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for selector, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        mine = chosen == selector
        if mine.any():
            from_, word = places[mine], np.full(int(mine.sum()), selector << 60, np.uint64)
            for j in range(count):
                word |= padded[from_ + j] << np.uint64(j * width)
            words[to[mine]] = word
    escaped = chosen == ESCAPE
    words[to[escaped]] = np.uint64(ESCAPE << 60)
    words[to[escaped] + 1] = padded[places[escaped]]
    offsets = to[np.searchsorted(places, np.arange(blocks) * stride)]
    return words, offsets.astype(np.uint32)


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of a coded array."""
    words = np.ascontiguousarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selectors == ESCAPE):  # escapes are rare
        if not raw[i]:
            raw[i + 1] = True
    steps = np.ones(16, np.int64)
    steps[: len(COUNTS)] = COUNTS
    sizes = np.where(raw, 0, steps[selectors])
    to = np.cumsum(sizes) - sizes
    out = np.zeros(n, np.uint64)
    for selector, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        mine = (selectors == selector) & ~raw
        if mine.any():
            at, word, mask = to[mine], words[mine], np.uint64((1 << width) - 1)
            for j in range(count):
                out[at + j] = (word >> np.uint64(j * width)) & mask
    escape = np.flatnonzero((selectors == ESCAPE) & ~raw)
    out[to[escape]] = words[escape + 1]
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, block: int, n: int) -> np.ndarray:
    """One block of an array of n values, without reading the others."""
    end = int(offsets[block + 1]) if block + 1 < len(offsets) else len(words)
    return decode(words[int(offsets[block]) : end], min(BLOCK, n - block * BLOCK))

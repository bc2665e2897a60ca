"""Words and word windows of many texts as 64-bit hashes, window hashes in whole-array numpy steps.

A word's hash is its XXH3 digest; a window's is a sum of its word hashes, each times an odd number of its
place, then mixed. Results are exact unless two different windows share all 64 bits.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Bytes of text hashed together.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same on every machine."""
    steps = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps) | np.uint64(1)


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text). Words are runs of bytes that are not ASCII white space."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        mine = text.lower().split() if lower else text.split()  # of bytes: ASCII letters and white space only
        counts[i] = len(mine)
        words += mine
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), counts


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; places too near the end of the array are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, m in enumerate(multipliers(k, 2)):
        out += hashes[j : j + n] * m
    return mix(out)


def chunks(texts, size: int = CHUNK_BYTES):
    """(first index, list of bytes) slices of an Arrow string column; NULL is empty."""
    held, total, first = [], 0, 0
    for i, text in enumerate(texts):
        text = text.as_buffer().to_pybytes() if text.is_valid else b""
        held.append(text)
        total += len(text)
        if total >= size:
            yield first, held
            held, total, first = [], 0, i + 1
    if held:
        yield first, held

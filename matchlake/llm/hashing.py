"""Hashes of words and word shingles, over whole batches of texts with numpy.

A word's hash is a polynomial of its bytes modulo 2**64, taken from running
sums, then mixed; a shingle's hash is a mixed polynomial of its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
# Bytes joined before hashing: bounds the working arrays, unless one text alone is longer.
BLOCK_BYTES = 1_000_000

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint64)
_LOWER = _SAME.copy()
_LOWER[65:91] += np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values, so that all output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(_BASE), table(pow(_BASE, -1, 2**64))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK_BYTES`` together."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the bounds of each text's words."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANK[joined]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edges = np.concatenate(([0], edges))
    first, past = edges[0::2], edges[1::2]
    size = 1 << max(len(joined), BLOCK_BYTES).bit_length()
    power, inverse = _powers(size)
    total = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _SAME)[joined] * power[: len(joined)], out=total[1:])
    raw = (total[past] - total[first]) * inverse[first]
    hashes = mix(raw + (past - first).astype(np.uint64) * _STEP)
    return hashes, np.concatenate(([0], np.searchsorted(first, ends)))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; none if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return words[:0]
    out = np.full(count, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        out *= _STEP
        out += words[k : k + count]
    return mix(out)


def shingle_sets(texts: list[bytes], n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole text is one shingle if it has fewer than ``n`` words."""
    for start, end in blocks(texts):
        words, bounds = word_hashes(texts[start:end], lower)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(gram_hashes(words[a:b], min(n, b - a))) if b > a else words[:0]

"""Wavelet matrices of token ids: bit planes with rank counts, one per shard of a corpus.

Plane k holds bit k of every token, highest bit first; after each plane the
tokens are split stably by that bit, zeros first. Access, counting and finding
a token's places walk down (or up) the planes with rank and select.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WMX1"
_HEADER = struct.Struct("<4sBQ")
# Bits under one stored rank.
BLOCK = 512


def build(tokens: np.ndarray, bits: int) -> bytes:
    """The file of a token array; ``bits`` planes hold ids below ``2**bits``."""
    n = len(tokens)
    kind = np.uint16 if bits <= 16 else np.uint32
    now = tokens.astype(kind)
    out = [_HEADER.pack(MAGIC, bits, n)]
    for k in range(bits - 1, -1, -1):
        plane = (now >> kind(k)) & kind(1) != 0
        packed = np.packbits(plane)
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.uint64) if n else []
        ranks = np.cumsum([0, *ones], dtype=np.uint64)
        out += [ranks.astype("<u8").tobytes(), packed.tobytes()]
        now = np.concatenate((now.take(np.flatnonzero(~plane)), now.take(np.flatnonzero(plane))))
    return b"".join(out)


class WaveletMatrix:
    """Reader of one file. Ranks are stored per ``BLOCK`` bits; the rest is counted in the packed plane."""

    def __init__(self, data: bytes):
        magic, self.bits, self.n = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at, blocks, size = _HEADER.size, -(-self.n // BLOCK), -(-self.n // 8)
        self.ranks, self.planes = [], []
        for _ in range(self.bits):
            self.ranks.append(np.frombuffer(data, "<u8", blocks + 1, at))
            at += 8 * (blocks + 1)
            self.planes.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        self.zeros = [self.n - int(r[-1]) for r in self.ranks]

    def _plane(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n).view(bool)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, BLOCK)
        first = block * BLOCK // 8
        inside = self.planes[level][first : first + -(-rest // 8)]
        return int(self.ranks[level][block]) + int(np.unpackbits(inside, count=rest).sum())

    def select(self, level: int, bit: bool, nth: int) -> int:
        """Place of the ``nth`` (from 0) one or zero of a plane."""
        ranks = self.ranks[level]
        if not bit:
            ranks = np.minimum(np.arange(len(ranks), dtype=np.uint64) * np.uint64(BLOCK), np.uint64(self.n)) - ranks
        block = int(np.searchsorted(ranks, nth, side="right")) - 1
        first = block * BLOCK
        bits = np.unpackbits(self.planes[level][first // 8 : (first + BLOCK) // 8], count=min(BLOCK, self.n - first))
        return first + int(np.flatnonzero(bits == bit)[nth - int(ranks[block])])

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        value = 0
        for level in range(self.bits):
            ones = self.rank1(level, i)
            bit = self.rank1(level, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            low, high = self.rank1(level, start), self.rank1(level, end)
            if token >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + low, self.zeros[level] + high
            else:
                start, end = start - low, end - high
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of ``token`` in places ``start`` to ``end`` (not included)."""
        if token >> self.bits:
            return 0
        low, high = self._range(token, start, self.n if end is None else end)
        return high - low

    def place(self, token: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence of ``token``."""
        i = self._range(token, 0, self.n)[0] + nth
        for level in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - level) & 1)
            i = self.select(level, one, i - self.zeros[level] if one else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order, by undoing the splits from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            plane = self._plane(level)
            before = np.empty_like(now)
            before[np.flatnonzero(~plane)] = now[: self.zeros[level]]
            before[np.flatnonzero(plane)] = now[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            now = before
        return now

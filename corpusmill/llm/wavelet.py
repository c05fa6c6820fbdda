"""A wavelet matrix over token ids in one compressed byte string, with lookups that open only the blocks they need.

Ids become their ranks by frequency (the alphabet is kept beside), so that high
planes are nearly empty.  Level 0 has the highest bit of every rank in order; each
further level has the next bit after a stable sort by the bit before.  Planes are cut into blocks
of `BLOCK` bits, each compressed by itself where that makes it smaller, with the
number of ones before it, so that rank and select touch one block each.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

BLOCK = 1 << 15
HEAD = struct.Struct("<QI")


def _sorted(bits: np.ndarray) -> np.ndarray:
    """Positions of the zeros, then of the ones: the order of a stable sort by one bit."""
    return np.concatenate((np.flatnonzero(~bits), np.flatnonzero(bits)))


def pack(ids: np.ndarray) -> bytes:
    """The matrix of `ids` as bytes; ids are those of a vocabulary, since a table up to the largest is made."""
    counts = np.bincount(ids)
    alphabet = np.flatnonzero(counts)
    alphabet = alphabet[np.argsort(-counts[alphabet], kind="stable")]
    n, levels = len(ids), max(len(alphabet) - 1, 0).bit_length()
    rank = np.zeros(len(counts), np.uint16 if levels <= 16 else np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    current = rank.take(ids)
    compress = zstandard.ZstdCompressor(level=1).compress
    blocks, sizes, ones = [], [], []
    for shift in range(levels - 1, -1, -1):
        bits = current & current.dtype.type(1 << shift) != 0
        for at in range(0, n, BLOCK):
            plain = np.packbits(part := bits[at : at + BLOCK], bitorder="little").tobytes()
            small = compress(plain)
            blocks.append(small if len(small) < len(plain) else plain)
            sizes.append(len(blocks[-1]))
            ones.append(int(np.count_nonzero(part)))
        current = current.take(_sorted(bits))
    return b"".join([HEAD.pack(n, len(alphabet)), alphabet.astype("<u4").tobytes(), np.array(sizes, "<u2").tobytes(), np.array(ones, "<u2").tobytes(), *blocks])


class WaveletMatrix:
    """Reads what `pack` wrote.  Positions count from 0; counts are of what comes before a position."""

    def __init__(self, data: bytes | memoryview):
        self.n, letters = HEAD.unpack_from(data)
        self.data = memoryview(data)
        self.alphabet = np.frombuffer(data, "<u4", letters, HEAD.size)
        self.levels, self.each, start = max(letters - 1, 0).bit_length(), -(-self.n // BLOCK), HEAD.size + 4 * letters
        count = self.each * self.levels
        sizes = np.frombuffer(data, "<u2", count, start).astype(np.int64)
        ones = np.frombuffer(data, "<u2", count, start + 2 * count).astype(np.int64).reshape(self.levels, self.each)
        self.at = np.append(0, np.cumsum(sizes)) + start + 4 * count
        self.before = np.concatenate((np.zeros((self.levels, 1), np.int64), np.cumsum(ones, 1)), 1)
        self.zeros = self.n - self.before[:, -1]
        self.plain = zstandard.ZstdDecompressor().decompress
        self.sums = lru_cache(4 * max(self.levels, 1))(self._sums)

    def rank(self, token: int) -> int | None:
        found = np.flatnonzero(self.alphabet == token)
        return int(found[0]) if len(found) else None

    def block(self, level: int, block: int) -> bytes:
        k = level * self.each + block
        raw, size = self.data[self.at[k] : self.at[k + 1]], min(BLOCK, self.n - block * BLOCK)
        return raw if len(raw) == -(-size // 8) else self.plain(raw)

    def bits(self, plain: bytes, size: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(plain, np.uint8), count=size, bitorder="little").view(bool)

    def _sums(self, level: int, block: int) -> np.ndarray:
        return np.append(0, np.cumsum(self.bits(self.block(level, block), min(BLOCK, self.n - block * BLOCK)), dtype=np.int32))

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a level before each position (up to n)."""
        block, out = np.minimum(at // BLOCK, self.each - 1), np.empty(len(at), np.int64)
        for b in np.unique(block).tolist():
            own = block == b
            out[own] = self.before[level, b] + self.sums(level, b)[at[own] - b * BLOCK]
        return out

    def select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Where the k-th (from 0) zero or one of a level stands."""
        before = self.before[level] if bit else np.minimum(np.arange(self.each + 1) * BLOCK, self.n) - self.before[level]
        block, out = np.searchsorted(before, k, "right") - 1, np.empty(len(k), np.int64)
        for b in np.unique(block).tolist():
            own, sums = block == b, self.sums(level, b)
            sums = sums if bit else np.arange(len(sums)) - sums
            out[own] = b * BLOCK + np.searchsorted(sums, k[own] - before[b], "right") - 1
        return out

    def take(self, positions: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at, out = np.asarray(positions, np.int64), np.zeros(len(positions), np.uint32)
        for level in range(self.levels):
            low = self.ones(level, at)
            bit = self.ones(level, at + 1) - low
            out = out << np.uint32(1) | bit.astype(np.uint32)
            at = np.where(bit == 1, self.zeros[level] + low, at - low)
        return self.alphabet.take(out)

    def _range(self, rank: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of a rank within [start, stop) stand below the last level."""
        ends = np.array([start, stop])
        for level in range(self.levels):
            ones = self.ones(level, ends)
            ends = self.zeros[level] + ones if rank >> self.levels - 1 - level & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        if (rank := self.rank(token)) is None:
            return 0
        a, b = self._range(rank, start, self.n if stop is None else stop)
        return b - a

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of `token`, ascending."""
        if (rank := self.rank(token)) is None:
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(rank, 0, self.n))
        for level in range(self.levels - 1, -1, -1):
            bit = rank >> self.levels - 1 - level & 1
            at = self.select(level, bit, at - self.zeros[level] * bit)
        return at

    def all(self) -> np.ndarray:
        """All ids in order: from the last level up, each undoes one stable sort."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = self.bits(b"".join(self.block(level, b) for b in range(self.each)), self.n)
            merged = np.empty_like(out)
            merged[_sorted(bits)] = out
            merged |= np.multiply(bits, out.dtype.type(1 << self.levels - 1 - level), dtype=out.dtype)
            out = merged
        return self.alphabet.take(out) if self.n else np.zeros(0, np.uint32)

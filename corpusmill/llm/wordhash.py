"""Vectorised word splitting and Rabin-Karp hashing for NumPy tasks.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All hashes are
polynomials modulo 2**64 taken from prefix sums, so a batch of texts is hashed
with a few array operations and no loop over words.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Fixed odd multipliers (golden-ratio and murmur finaliser constants).
BASE_BYTES = 0x9E3779B97F4A7C15
BASE_WORDS = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x + np.uint64((int(salt) * BASE_BYTES) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[base] = have
    return have


def prefix_sums(values: np.ndarray, down: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words of each text."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([True], SPACE[buffer])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(BASE_BYTES, len(buffer) + 1)
    sums = prefix_sums(buffer.astype(np.uint64) + np.uint64(1), down)
    hashes = mix((sums[ends] - sums[starts]) * up[starts], 1) + (ends - starts).astype(np.uint64)
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    counts = np.diff(np.searchsorted(starts, bounds))
    return mix(hashes, 2), counts


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` consecutive values (empty if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(hashes) + 1)
    sums = prefix_sums(hashes, down)
    return mix((sums[width : width + n] - sums[:n]) * up[:n], width)


def runs(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Split positions 0..len(sizes) into consecutive runs of about `limit` in total; a larger item is alone."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            out.append((start, i))
            start, total = i, 0
        total += size
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out

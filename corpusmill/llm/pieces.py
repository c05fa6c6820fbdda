"""Vectorised cutting of texts into the pieces of the usual byte-level pattern, and their distinct kinds.

The pattern takes contractions ('s 't 're 've 'm 'll 'd), then runs of letters,
of numbers or of other marks with at most one space before them, then white
space, of which the last character stays out if something follows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .wordhash import BASE_BYTES, mix, powers, prefix_sums

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for code, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = code
    return out


def cut(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of texts laid end to end; texts start at `doc_starts` (non-empty ones)."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last of a run of white space that something follows: a space opens the next piece, others stand alone.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # Contractions begin at an apostrophe that opens a piece.
    quote = np.flatnonzero(points[:-1] == 39)
    quote = quote[start[quote] & ~first[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = np.where(first[np.minimum(quote + 2, n)], 0, points[np.minimum(quote + 2, n - 1)])
        length = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 2, 0))
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        after = quote + 1 + length
        start[after[after < n]] = True
    return np.flatnonzero(start)


def distinct(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces [starts[i], starts[i+1]): the first position of each kind, and the kind of each piece.

    Kinds come from 64-bit hashes and are then compared code point by code point.
    """
    up, down = powers(BASE_BYTES, len(points) + 1)
    sums = prefix_sums(points.astype(np.uint64) + np.uint64(1), down)
    ends = np.append(starts[1:], len(points))
    size = ends - starts
    hashes = mix((sums[ends] - sums[starts]) * up[starts], 1) + size.astype(np.uint64)
    _, where, kind = np.unique(hashes, return_index=True, return_inverse=True)
    shift = np.repeat(starts[where][kind] - starts, size)
    if not (np.array_equal(size[where][kind], size) and np.array_equal(points[np.arange(len(points)) + shift], points)):
        where = kind = np.arange(len(starts))
    return where, kind

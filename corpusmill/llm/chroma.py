"""Chroma fingerprints of audio columns, and alignment of recordings by them.

A recording is a binary column of unsigned 8-bit mono samples.  Overlapping
frames are transformed to spectra, whose energy is folded into twelve pitch
classes.  Box sums over the integral image of this (time x pitch class) picture
give sixteen filter responses at each position, each quantised to two bits: one
32-bit integer a position.  Two recordings are aligned at the offset that most of
their equal integers agree on, and compared there by their share of differing bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions
from .wordhash import mix, runs

FRAME, HOP, SPAN, RATE = 128, 32, 8, 11025
#: The first frequency bin that is less than a semitone below the next: 1 / (2**(1/12) - 1), rounded up.
LOWEST = 17
#: Positions between the two values of an anchor.
PAIR = 4
#: Fewer positions than this are few enough for one edit (some 15 positions) at a bad place to leave too few anchors.
SMALL = 22
#: Frames transformed at once.
BATCH = 1 << 15
#: Pairs of places that meet, or are compared, at once.
PAIRS = 1 << 20
#: Positions of recordings that are looked at together.
POSITIONS = 1 << 19


def _pitch_classes() -> np.ndarray:
    """(frequency bin, pitch class) weights: each bin's energy goes to the class nearest on the tempered scale.

    Bins lower than `LOWEST`, whose neighbours are a semitone away or more, tell no classes apart and have no weight."""
    bins = np.arange(LOWEST, FRAME // 2 + 1)
    out = np.zeros((FRAME // 2 + 1, 12), np.float32)
    out[bins, np.round(12 * np.log2(bins * RATE / FRAME / 440)).astype(int) % 12] = 1
    return out


def _filters() -> list[tuple[int, int, int, str]]:
    """(first class, classes, frames, kind) of the sixteen filters: every kind of split over bands of three sizes."""
    bands = [(0, 12), (0, 6), (6, 6), (3, 6)]
    return [(at, size, SPAN if kind != "third" else 6, kind) for kind in ("time", "pitch", "cross", "third") for at, size in bands]


FILTERS, CLASSES, WINDOW = _filters(), _pitch_classes(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class energies, one row a frame; each row has unit length."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    parts = []
    for a in range(0, n, BATCH):
        part = (frames[a : a + BATCH].astype(np.float32) - 128) * WINDOW
        parts.append((np.abs(np.fft.rfft(part, axis=1)) ** 2).astype(np.float32) @ CLASSES)
    out = np.concatenate(parts)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One uint32 for each position at which a whole filter fits."""
    picture = chroma(samples)
    n = len(picture) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(picture) + 1, 13))
    integral[1:, 1:] = picture.cumsum(0, dtype=np.float64).cumsum(1)
    t = np.arange(n)

    def box(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return integral[t + t1, c1] - integral[t + t0, c1] - integral[t + t1, c0] + integral[t + t0, c0]

    out = np.zeros(n, np.uint32)
    for k, (c, size, frames, kind) in enumerate(FILTERS):
        half, mid = frames // 2, c + size // 2
        whole = box(0, frames, c, c + size)
        if kind == "time":
            part = box(0, half, c, c + size)
        elif kind == "pitch":
            part = box(0, frames, c, mid)
        elif kind == "cross":
            part = box(0, half, c, mid) + box(half, frames, mid, c + size)
        else:  # the middle third in time, counted as half
            part = 1.5 * box(frames // 3, 2 * frames // 3, c, c + size)
        share = part / np.maximum(whole, 1e-9)
        level = (share > 0.45).astype(np.uint32) + (share > 0.5) + (share > 0.55)
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * k)  # Gray code: neighbours differ in one bit
    return out


def fingerprints(rows: DataFrame, audio_col: str, out_col: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (little-endian uint32 values, packed) of each recording; null and short ones have an empty one."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda b: fingerprint(np.frombuffer(b or b"", np.uint8)).tobytes())

    return rows.withColumn(out_col, run(audio_col))


def _values(prints: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The anchor at each position (or those at `at`): the hash of two values `PAIR` positions apart."""
    at = np.arange(max(0, len(prints) - PAIR)) if at is None else at
    return mix(prints[at].astype(np.uint64), 7) ^ mix(prints[at + PAIR].astype(np.uint64), 8)


def _join(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _packed(out: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=columns)


def _flat(prints: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints one after another, and the number of positions of each."""
    return np.frombuffer(b"".join(prints), np.uint32), np.array([len(b) // 4 for b in prints], np.int64)


def _anchors(flat: np.ndarray, n: np.ndarray, apart: int = PAIR, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position in `flat`, recording, place) of all pairs of values `apart` positions apart, in order; `which` chooses recordings."""
    have = np.maximum(0, n - apart)
    if which is not None:
        have = np.where(which, have, 0)
    owner = np.repeat(np.arange(len(n)), have)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(have) - have, have)
    return (np.cumsum(n) - n)[owner] + place, owner, place


def _postings(spread: int, salts: int, least_votes: int):
    """Which values each recording has, packed by (bucket of the value, salt): value, class, places (`least_votes` at most) and what it is.

    A value is data (1) in the salt of its class and, where the class asks, a question (2) in all salts.  Where an edit could
    spoil all anchors (under `SMALL` positions) pairs of neighbouring values (4) are added, which make a candidate but no vote."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            prints, ids, asked = rows["print"].to_numpy(), rows["class"].to_numpy(np.int64), rows["asked"].to_numpy(bool)
            for a, b in runs([len(x) // 4 for x in prints], POSITIONS):
                yield _packed(list(packed(*_flat(prints[a:b]), ids[a:b], asked[a:b])), ["bucket", "data"])

    def packed(flat: np.ndarray, n: np.ndarray, ids: np.ndarray, asked: np.ndarray) -> Iterator[tuple[int, bytes]]:
        at, owner, _ = _anchors(flat, n)
        next_to, small, _ = _anchors(flat, n, 1, n < SMALL)
        near = mix(flat[next_to].astype(np.uint64), 6) ^ mix(flat[next_to + 1].astype(np.uint64), 4)
        value, owner, flag = np.append(_values(flat, at), near), np.append(owner, small), np.repeat(np.array([0, 4], np.uint8), (len(at), len(near)))
        order = np.argsort(value, kind="stable")  # owners stay in order
        value, owner, flag = value[order], owner[order], flag[order]
        first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]) | (flag[1:] != flag[:-1]))) if len(value) else np.zeros(0, np.int64)
        places = np.minimum(np.diff(np.append(first, len(value))), least_votes).astype(np.int32)
        value, owner, flag = value[first], owner[first], flag[first]
        # Values are hashes, so equal ranges of them are buckets; there the lower half will do, as equal halves only make a candidate more.
        bucket = ((value >> np.uint64(32)) * np.uint64(spread) >> np.uint64(32)).astype(np.int64)
        own = (mix(ids.astype(np.uint64), 2) % np.uint64(salts)).astype(np.int64)[owner]
        ids, asked = ids[owner], asked[owner]
        cut = np.searchsorted(bucket, np.arange(spread + 1))
        for v in range(spread):
            here = slice(cut[v], cut[v + 1])
            for salt in range(salts):
                at = np.flatnonzero((own[here] == salt) | asked[here]) + cut[v]
                if len(at):
                    what = flag[at] | (own[at] == salt) | asked[at].astype(np.uint8) << 1
                    yield v * salts + salt, np.int64(len(at)).tobytes() + value[at].astype(np.uint32).tobytes() + ids[at].tobytes() + places[at].tobytes() + what.astype(np.uint8).tobytes()

    return run


#: What is packed of a candidate: question, other class, most votes that one offset can have, whether neighbouring values are shared.
CANDIDATE = (np.int64, np.int64, np.int32, bool)


def _unpacked(data: Iterable[bytes], kinds: tuple) -> list[np.ndarray]:
    parts: list[list] = [[] for _ in kinds]
    for b in data:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for part, kind in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(b, kind, n, at))
            at += np.dtype(kind).itemsize * n
    return [_join(part, kind) for part, kind in zip(parts, kinds, strict=True)]


def _summed(pair: np.ndarray, votes: np.ndarray, near: np.ndarray, least_votes: int) -> tuple[np.ndarray, ...]:
    """Each pair once, in order, with its votes (`least_votes` at most)."""
    order = np.argsort(pair, kind="stable")
    pair, votes, near = pair[order], votes[order], near[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    if len(first):
        votes, near = np.minimum(np.add.reduceat(votes.astype(np.int64), first), least_votes).astype(np.int32), np.logical_or.reduceat(near, first)
    return pair[first], votes, near


def _dealt(q: np.ndarray, d: np.ndarray, votes: np.ndarray, near: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(q):
        return
    order = np.argsort(block, kind="stable")
    keys, first = np.unique(block[order], return_index=True)
    for k, at in zip(keys.tolist(), np.split(order, first[1:]), strict=True):
        yield k, np.int64(len(at)).tobytes() + q[at].tobytes() + d[at].tobytes() + votes[at].tobytes() + near[at].tobytes()


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64), 1) % np.uint64(blocks)).astype(np.int64)


def _meet(blocks: int, least_votes: int):
    """Candidates of a bucket: each question with a value meets all other classes that have it, `PAIRS` at a time; places are not multiplied.

    At one offset a value gives two recordings no more votes than the one with fewer places of it has places."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        value, ids, places, what = _unpacked(rows["data"], (np.uint32, np.int64, np.int32, np.uint8))
        names, ids = np.unique(ids, return_inverse=True)
        data, asks = np.flatnonzero(what & 1), np.flatnonzero(what & 2)
        data = data[np.argsort(value[data], kind="stable")]
        low, high = (np.searchsorted(value[data], value[asks], side=s) for s in ("left", "right"))
        met = high - low
        pair, votes, near = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        for a, b in runs(met.tolist(), PAIRS):
            i = np.repeat(np.arange(a, b), met[a:b])
            j = data[low[i] + np.arange(len(i)) - np.repeat(np.cumsum(met[a:b]) - met[a:b], met[a:b])]
            i = asks[i]
            keep = ids[i] != ids[j]
            i, j = i[keep], j[keep]
            by = what[i] & what[j] & 4 > 0
            new = ids[i] * len(names) + ids[j], np.where(by, 0, np.minimum(places[i], places[j])).astype(np.int32), by
            pair, votes, near = _summed(*(np.concatenate(x) for x in zip((pair, votes, near), new, strict=True)), least_votes)
        q, d = names[pair // max(1, len(names))], names[pair % max(1, len(names))]
        return _packed(list(_dealt(q, d, votes, near, _block(q, blocks))), ["block", "data"])

    return run


def _pick(blocks: int, least_votes: int):
    """The candidates that may have `least_votes` or share neighbouring values, and the prints of those that ask, dealt by the other side."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        q, d, votes, near = _unpacked(rows["data"], CANDIDATE)
        names, d = np.unique(d, return_inverse=True)
        own, prints = asked["class"].to_numpy(np.int64), asked["print"].to_numpy()
        order = np.argsort(own)
        own, prints = own[order], prints[order]
        pair, votes, near = _summed(np.searchsorted(own, q) * len(names) + d, votes, near, least_votes)
        keep = np.flatnonzero((votes >= least_votes) | near)
        i, d, votes, near = pair[keep] // max(1, len(names)), names[pair[keep] % max(1, len(names))], votes[keep], near[keep]
        out = []
        for k, data in _dealt(own[i], d, votes, near, _block(d, blocks)):
            at = np.unique(np.searchsorted(own, np.frombuffer(data, np.int64, int(np.frombuffer(data, np.int64, 1)[0]), 8)))
            flat, sizes = _flat(prints[at])
            out.append((k, data, own[at].tobytes(), sizes.tobytes(), flat.tobytes()))
        return _packed(out, ["block", "data", "ids", "sizes", "prints"])

    return run


def _known(y: np.ndarray, yn: np.ndarray) -> tuple[np.ndarray, ...]:
    """The values of recordings one after another, and each anchor's value (as its number), recording and place."""
    at, owner, place = _anchors(y, yn)
    known, rank = np.unique(_values(y, at), return_inverse=True)
    return known, rank, owner, place


def _best_offsets(x: np.ndarray, xn: np.ndarray, y: tuple[np.ndarray, ...], yn: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of recordings (i of x, j of those `_known`) the offset with most votes, then the nearest to 0 (the positive of two), and its votes.

    Only values on both sides are looked at; pairs of places are counted straight into the offsets of their pair, `PAIRS` at a time."""
    known, ry, oy, py = y
    at, ox, px = _anchors(x, xn)
    value = _values(x, at)
    rx = np.minimum(np.searchsorted(known, value), max(0, len(known) - 1))
    both = np.flatnonzero(known[rx] == value) if len(known) else at[:0]
    shared = np.zeros(len(known), bool)
    shared[rx[both]] = True
    key, px = ox[both] * len(known) + rx[both], px[both]
    order = np.argsort(key, kind="stable")
    key, px = key[order], px[order]
    both = np.flatnonzero(shared[ry])
    ry, oy, py = ry[both], oy[both], py[both]
    y0, y1 = (np.searchsorted(oy, np.arange(len(yn)), side=s) for s in ("left", "right"))
    width = xn[i] + yn[j]
    offset, votes = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for a, b in runs(((y1 - y0)[j] + width).tolist(), PAIRS):
        size = (y1 - y0)[j[a:b]]
        pair = np.repeat(np.arange(a, b), size)
        e = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + y0[j[pair]]
        look = i[pair] * len(known) + ry[e]
        low, high = (np.searchsorted(key, look, side=s) for s in ("left", "right"))
        met = high - low
        base = np.cumsum(width[a:b]) - width[a:b]
        count = np.zeros(int(width[a:b].sum()), np.int64)
        for c, f in runs(met.tolist(), PAIRS) if met.sum() > PAIRS else [(0, len(met))]:
            k = np.repeat(np.arange(c, f), met[c:f])
            m = low[k] + np.arange(len(k)) - np.repeat(np.cumsum(met[c:f]) - met[c:f], met[c:f])
            k, to = pair[k], py[e[k]] - px[m]
            count += np.bincount(base[k - a] + to + xn[i[k]], minlength=len(count))
        most = np.maximum.reduceat(count, base)
        top = np.flatnonzero(count == np.repeat(most, width[a:b]))
        k = np.searchsorted(base, top, side="right") - 1
        to = top - base[k] - xn[i[k + a]]
        nearest = np.minimum.reduceat(2 * np.abs(to) + (to < 0), np.searchsorted(k, np.arange(b - a)))
        offset[a:b], votes[a:b] = np.where(nearest & 1, -(nearest >> 1), nearest >> 1), most
    return offset, votes


def _bit_errors(x: np.ndarray, x0: np.ndarray, xn: np.ndarray, y: np.ndarray, y0: np.ndarray, yn: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlap and share of differing bits of pairs of prints x[x0:x0+xn], y[y0:y0+yn] at their offsets."""
    p, q = np.maximum(0, -offset), np.maximum(0, offset)
    n = np.maximum(0, np.minimum(xn - p, yn - q)).astype(np.int64)
    error = np.ones(len(n))
    for a, b in runs(n.tolist(), PAIRS):
        some = np.flatnonzero(n[a:b]) + a
        if len(some):
            size = n[some]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            bits = np.bitwise_count(x[np.repeat(x0[some] + p[some], size) + at] ^ y[np.repeat(y0[some] + q[some], size) + at])
            error[some] = np.add.reduceat(bits.astype(np.int64), np.cumsum(size) - size) / (32 * size)
    return n, error


def _score(least_votes: int, most_error: float):
    """Matches of a block's recordings with those that ask: for each of these their number and the best."""

    def run(pairs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(own["class"].to_numpy(np.int64))
        ids, (y, yn) = own["class"].to_numpy(np.int64)[order], _flat(own["print"].to_numpy()[order])
        y0, values, out = np.cumsum(yn) - yn, _known(y, yn), []
        for a, b in runs([len(x) // 4 for x in pairs["prints"]], POSITIONS):
            q, d, _, near = _unpacked(pairs["data"][a:b], CANDIDATE)
            names, xn, x = (np.frombuffer(b"".join(pairs[c][a:b]), kind) for c, kind in (("ids", np.int64), ("sizes", np.int64), ("prints", np.uint32)))
            x0 = np.cumsum(xn) - xn
            sorted_names = np.argsort(names)
            i, j = sorted_names[np.searchsorted(names[sorted_names], q)], np.searchsorted(ids, d)
            offset, votes = _best_offsets(x, xn, values, yn, i, j)
            overlap, error = _bit_errors(x, x0[i], xn[i], y, y0[j], yn[j], offset)
            error[votes < least_votes] = 1.0
            small = np.flatnonzero((error > most_error) & ((votes >= least_votes) | near) & (np.maximum(xn[i], yn[j]) < SMALL))
            lengths = xn[i][small] << 8 | yn[j][small]
            for both in np.unique(lengths):
                at = small[lengths == both]
                p, r = (v[s[:, None] + np.arange(n)] for v, s, n in ((x, x0[i[at]], both >> 8), (y, y0[j[at]], both & 255)))
                found, shift = _fewest_errors(p, r)
                fine = found <= most_error + 1e-6
                at, shift = at[fine], shift[fine].astype(np.int64)
                offset[at] = shift
                overlap[at], error[at] = _bit_errors(x, x0[i[at]], xn[i[at]], y, y0[j[at]], yn[j[at]], shift)
                votes[at] = [_votes_at(x[x0[a] : x0[a] + xn[a]], y[y0[b] : y0[b] + yn[b]], int(o)) for a, b, o in zip(i[at], j[at], shift, strict=True)]
            fine = np.flatnonzero(error <= most_error)
            fine = fine[np.lexsort((d[fine], -votes[fine], error[fine], q[fine]))]
            q, first, matches = np.unique(q[fine], return_index=True, return_counts=True)
            at = fine[first]
            out.append(pd.DataFrame({"q": q, "matches": matches, "error": error[at], "votes": votes[at], "d": d[at], "offset": offset[at], "overlap": overlap[at]}))
        return pd.concat(out) if out else _packed([], ["q", "matches", "error", "votes", "d", "offset", "overlap"])

    return run


def _error(p: np.ndarray, q: np.ndarray, offset: int) -> tuple[int, float]:
    p, q = p[max(0, -offset) :], q[max(0, offset) :]
    n = min(len(p), len(q))
    return n, float(np.bitwise_count(p[:n] ^ q[:n]).sum()) / (32 * n) if n else 1.0


def _offsets(n: int, m: int) -> list[int]:
    """Offsets, nearest to 0 first, at which two fingerprints of n and m values share half of the longer one."""
    least = -(-max(n, m) // 2)
    return sorted((o for o in range(-n + 1, m) if min(n - max(0, -o), m - max(0, o)) >= least), key=lambda o: (abs(o), -o))


def _fewest_errors(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(error, offset) with fewest errors over `_offsets`; positions are the last axis, the others are broadcast."""
    n, m = p.shape[-1], q.shape[-1]
    shape = np.broadcast_shapes(p.shape[:-1], q.shape[:-1])
    error, offset = np.full(shape, 2.0, np.float32), np.zeros(shape, np.int8)
    for o in _offsets(n, m):
        size = min(n - max(0, -o), m - max(0, o))
        bits = np.zeros(shape, np.uint16)
        for k in range(size):
            bits += np.bitwise_count(p[..., k + max(0, -o)] ^ q[..., k + max(0, o)])
        share = bits / np.float32(32 * size)
        better = share < error
        error[better], offset[better] = share[better], o
    return error, offset


def _votes_at(p: np.ndarray, q: np.ndarray, offset: int) -> int:
    p, q = p[max(0, -offset) :], q[max(0, offset) :]
    same = p[: len(q)] == q[: len(p)]
    return int((same[:-PAIR] & same[PAIR:]).sum())


def _short_matches(classes: DataFrame, short: int, most_error: float, block_rows: int = 1024) -> DataFrame:
    """(q, d, votes, offset, overlap, error) of all matches in which one side has fewer than `short` positions.

    No anchors are asked for: all pairs are compared at all offsets that share half of the longer side, in pairs of
    bounded blocks.  So the other side has fewer than 2 * short positions."""
    kind = dict(classes.dtypes)["class"]
    some = classes.where((F.octet_length("print") > 0) & (F.octet_length("print") < 8 * short))
    asked = some.where("asked")
    nq, nd = (max(1, -(-x.count() // block_rows)) for x in (asked, some))

    def dealt(rows: DataFrame, side: str, blocks: int, others: int, mine: str, other: str) -> DataFrame:
        out = rows.select(F.col("class").alias(side), F.col("print").alias(f"p{side}"), F.pmod(F.xxhash64("class"), F.lit(blocks)).alias(mine))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []

        def groups(rows: pd.DataFrame, side: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for n, own in rows.groupby(rows[f"p{side}"].map(len) // 4):
                yield int(n), own[side].to_numpy(), np.frombuffer(b"".join(own[f"p{side}"]), np.uint32).reshape(-1, int(n))

        for n, ids, p in groups(left, "q"):
            for m, others, q in groups(right, "d"):
                if min(n, m) >= short:
                    continue
                error, offset = _fewest_errors(p[:, None], q[None])
                fine = (error <= most_error + 1e-6) & (ids[:, None] != others[None])
                for i, j in zip(*np.nonzero(fine), strict=True):
                    o = int(offset[i, j])
                    overlap, e = _error(p[i], q[j], o)
                    out.append((ids[i], others[j], _votes_at(p[i], q[j], o), o, overlap, e))
        return pd.DataFrame(out, columns=["q", "d", "votes", "offset", "overlap", "error"]).astype({"votes": "int32", "offset": "int32", "overlap": "int32", "error": "float64"})

    a, b = dealt(asked, "q", nq, nd, "x", "y"), dealt(some, "d", nd, nq, "y", "x")
    return a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInPandas(run, f"q {kind}, d {kind}, votes int, offset int, overlap int, error double")


def align(rows: DataFrame, queries: Column, *, id_col: str = "doc_id", audio_col: str = "audio", least_votes: int = 3, most_error: float = 0.15, block_positions: int = 1_000_000) -> DataFrame:
    """For each row where `queries` holds: (id_col, n_positions, class_id, copies, matches, match_id, offset, votes, overlap, error).

    Recordings with equal fingerprints are one class; `copies` is its size.  Candidates
    share anchors (a pair of fingerprint values `PAIR` positions apart, as single values coincide too often),
    or two neighbouring values where both have fewer than `SMALL` positions.  All places of all anchors of
    two candidates vote; the offset with most votes is theirs, with `least_votes` of them at least, and they match with
    `most_error` differing bits at most.  Where that fails, two recordings under `SMALL` positions take the offset with
    fewest errors, as do recordings too short for `least_votes` anchors, which are compared without candidates; offsets
    of this kind share half of the longer side.  `matches` counts the other classes that match; the best is told by
    its smallest id (fewest errors, then most votes, then smallest id).

    Ids are integers; null ids are no rows of the index.  Null, empty and short audio has no position and
    matches nothing but its copies.  Rows that repeat an id each come back once, if they ask; a repeated row counts as a
    copy.  An empty table gives an empty one.  Audio of any length is read whole.  Other columns, whatever their names, play no part.

    Recordings meet in buckets of anchor values, once for each value whatever its places.  A value in many recordings is dealt over a
    number of tasks that grows with the buckets, and questions meet it there `PAIRS` classes at a time; what leaves a task is packed
    pairs with the most votes they can have.  Votes are counted where the prints of both sides are, and only for pairs that
    may have `least_votes`, so that no table of votes by offset is ever held or moved.
    """
    parts = shuffle_partitions(rows.sparkSession)
    base = rows.select(F.col(id_col).cast("long").alias("id"), queries.alias("asked"), F.col(audio_col).alias("audio")).where("id is not null")
    prints = checkpointed(fingerprints(base, "audio", "print").select("id", "asked", "print").withColumn("mark", F.sha2("print", 256)))
    classes = checkpointed(prints.groupBy("mark").agg(F.min("id").alias("class"), F.max(F.coalesce("asked", F.lit(False))).alias("asked"), F.count("*").alias("copies"), F.first("print").alias("print")))
    short = least_votes + PAIR
    long = classes.where(F.octet_length("print") >= 4 * short).select("class", "asked", "print")
    positions = (long.agg(F.sum(F.octet_length("print"))).first()[0] or 0) // 4
    blocks = max(parts, -(-positions // block_positions))
    salts = max(1, round(math.sqrt(blocks) / 2))
    spread = max(1, blocks // salts)

    @F.pandas_udf("long")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(_block(ids.to_numpy(np.int64), blocks))

    dealt = long.withColumn("block", block_of("class"))
    met = long.mapInPandas(_postings(spread, salts, least_votes), "bucket long, data binary").repartition(max(parts, spread * salts), "bucket").groupBy("bucket").applyInPandas(_meet(blocks, least_votes), "block long, data binary")
    picked = met.groupBy("block").cogroup(dealt.where("asked").groupBy("block")).applyInPandas(_pick(blocks, least_votes), "block long, data binary, ids binary, sizes binary, prints binary")
    result = "q long, matches long, error double, votes long, d long, offset long, overlap long"
    scored = picked.groupBy("block").cogroup(dealt.groupBy("block")).applyInPandas(_score(least_votes, most_error), result)
    brief = _short_matches(classes, short, most_error).where(F.col("error") <= most_error).select("q", F.lit(1).cast("long").alias("matches"), "error", F.col("votes").cast("long"), "d", F.col("offset").cast("long"), F.col("overlap").cast("long"))
    best = F.min(F.struct("error", (-F.col("votes")).alias("v"), "d", "offset", "votes", "overlap")).alias("b")
    top = scored.unionByName(brief).groupBy("q").agg(F.sum("matches").alias("matches"), best)
    asked = prints.where("asked").select("id", "mark", (F.octet_length("print") / 4).cast("long").alias("n_positions")).join(classes.select("mark", "class", "copies"), "mark")
    out = asked.join(top, F.col("class") == F.col("q"), "left")
    return out.select(F.col("id").alias(id_col), "n_positions", F.col("class").alias("class_id"), "copies", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.col("b.d").alias("match_id"), F.col("b.offset").cast("int").alias("offset"), F.col("b.votes").cast("int").alias("votes"), F.col("b.overlap").cast("int").alias("overlap"), F.round("b.error", 9).alias("error"))

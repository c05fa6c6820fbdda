"""Exact nearest neighbours of vectors, in blocks.

Both sides are dealt into blocks by the hash of their id; each pair of blocks is
one task, which multiplies tiles of two bounded matrices and keeps the best k of each
row.  Work is quadratic, as exact search is; no task holds more than two blocks,
and a thousand-fold table needs more tasks, not larger ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .dedup import greedy_keep


def _dealt(df: DataFrame, blocks: int, others: int, side: str, mine: str, other: str) -> DataFrame:
    """Each row in its own block, once for each block of the other side; every column named for its side."""
    out = df.select(F.col("id").alias(f"{side}_id"), F.col("vec").alias(f"{side}_vec"))
    return out.withColumn(f"{side}_{mine}", F.pmod(F.xxhash64(f"{side}_id"), F.lit(blocks))).withColumn(f"{side}_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))


#: Rows of a block that one task multiplies, and rows and columns of the tiles that it works on.
BLOCK, TILE = 32768, (512, 2048)
#: Pairs of blocks have a task each, up to so many tasks.
TASKS = 4096


def _blocks(n: int, most: int) -> int:
    """Blocks of `most` rows at most; eight of them where that leaves a thousand rows to each, so that small tables make enough tasks."""
    return max(1, -(-n // most), min(8, n // 1024))


def _copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their equals; no later one can be among the k best of anything."""
    key = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    place = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    keep = np.zeros(len(key), bool)
    keep[order[place < k]] = True
    return keep


def _merged(best: tuple, rows: np.ndarray, sims: np.ndarray, ids: np.ndarray, k: int) -> None:
    """The best k of each row brought up to date with new (row, sim, id)."""
    values, known = best
    touched, at = np.unique(rows, return_inverse=True)
    r = np.concatenate((at, np.repeat(np.arange(len(touched)), k)))
    s, i = np.concatenate((sims, values[touched].ravel())), np.concatenate((ids, known[touched].ravel()))
    order = np.lexsort((i, -np.round(s, 12), r))
    r, s, i = r[order], s[order], i[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    first = place < k
    values[touched[r[first]], place[first]], known[touched[r[first]], place[first]] = s[first], i[first]


def _places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a contiguous mask with few places set: it looks at eight of them at a time first."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    return (eights[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[eights]]


def _under(sims: np.ndarray, k: int) -> np.ndarray:
    """For each row a number that at least k of its columns reach: the k-th of the maxima of 16 columns each, or of all columns where there are few."""
    if sims.shape[1] % 16 == 0 and sims.shape[1] // 16 >= k:
        sims = sims.reshape(len(sims), 16, -1).max(axis=1)
    return np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]


def _nearest(m: np.ndarray, ids: np.ndarray, n: np.ndarray, others: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, ids), k columns each: the best k rows of `n` (ids ascending) for each row of `m`, in double precision; -inf where there are fewer.

    Tiles are multiplied in single precision, whose error is bounded; only what may be among the best is multiplied again in double,
    as soon as a few places for each row have come together.
    """
    values, known = np.full((len(m), k), -np.inf), np.full((len(m), k), np.iinfo(np.int64).max)
    lengths = np.linalg.norm(m, axis=1)
    lengths[lengths == 0] = 1.0
    largest = max(np.linalg.norm(n, axis=1).max(initial=0.0), 1e-300)
    small, others32 = (m / lengths[:, None]).astype(np.float32), (n / largest).astype(np.float32)
    margin = 2 * (m.shape[1] + 8) * float(np.finfo(np.float32).eps)
    scale = lengths * largest
    floor = -np.inf if least is None else least
    high, wide = TILE
    room = np.empty(TILE, np.float32), np.empty(TILE, bool)
    for i in range(0, len(m), high):
        mine = slice(i, i + high)
        best = values[mine], known[mine]
        part, own = small[mine], ids[mine]
        bound, waiting, count = None, [], 0
        for j in range(0, len(n), wide):
            across = others32[j : j + wide].T
            whole = (len(part), across.shape[1]) == TILE
            sims = np.matmul(part, across, out=room[0] if whole else None)
            if bound is None:
                # Below the bound, even with the error of both, nothing is among the best.
                bound = np.maximum(best[0][:, k - 1], floor) / scale[mine] - margin
            if (j == 0 or not np.isfinite(bound).all()) and sims.shape[1] > k + 1:
                # The k best of the tile and the row itself come before anything under this.
                bound = np.maximum(bound, _under(sims, k + 1) - margin)
            bound = np.where(np.isnan(bound), -np.inf, bound).astype(np.float32)
            flat = _places(np.greater_equal(sims, bound[:, None], out=room[1] if whole else None))
            waiting.append((flat // sims.shape[1], flat % sims.shape[1] + j))
            count += len(flat)
            if count < 4 * len(part) and j + wide < len(n):
                continue
            r, c = (np.concatenate(x) for x in zip(*waiting, strict=True))
            bound, waiting, count = None, [], 0
            other = own[r] != others[c]
            r, c = r[other], c[other]
            if len(r):
                exact = np.concatenate([np.einsum("ij,ij->i", m[i + r[x : x + 65536]], n[c[x : x + 65536]]) for x in range(0, len(r), 65536)])
                fine = np.isfinite(exact) & (exact >= floor)
                if fine.any():
                    _merged(best, r[fine], exact[fine], others[c[fine]], k)
    return values, known


def top_k(left: DataFrame, right: DataFrame, k: int, *, least: float | None = None, block_rows: int = BLOCK, unit: bool = True) -> DataFrame:
    """(src, dst, sim, rank): for each row of `left` (id, vec) its k best of `right`, never itself.

    Similarity is the dot product in double precision (the cosine of unit vectors;
    `unit` scales them); ties go to the smaller id.  With `least`, only similarities of that at least.
    """
    nl, nr = (_blocks(side.count(), block_rows) for side in (left, right))
    tasks = min(nl * nr, TASKS)  # a given number, as few bytes of vectors are much work and would be put into few tasks
    a = _dealt(left, nl, nr, "l", "x", "y").repartition(tasks, "l_x", "l_y")
    b = _dealt(right, nr, nl, "r", "y", "x").repartition(tasks, "r_x", "r_y")

    def best(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = {"src": [], "dst": [], "sim": []}
        if len(p) and len(q):
            ids, dst = p["l_id"].to_numpy(), q["r_id"].to_numpy()
            m, n = (np.stack([np.asarray(v, np.float64) for v in s]) for s in (p["l_vec"], q["r_vec"]))
            order = np.argsort(dst, kind="stable")
            n, dst = n[order], dst[order]
            kept = _copies(n, k + 1)
            n, dst = n[kept], dst[kept]
            if unit:
                m, n = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (m, n))
            (m, ids), (n, dst) = ((v[ok], i[ok]) for v, i in ((m, ids), (n, dst)) for ok in [np.isfinite(v).all(1)])
            sims, found = _nearest(m, ids, n, dst, k, least)
            fine = np.isfinite(sims)
            out = {"src": np.repeat(ids, k)[fine.ravel()], "dst": found[fine], "sim": sims[fine]}
        return pd.DataFrame(out).astype({"src": "int64", "dst": "int64", "sim": "float64"})

    pairs = a.groupBy("l_x", "l_y").cogroup(b.groupBy("r_x", "r_y")).applyInPandas(best, "src long, dst long, sim double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("sim", 12).desc(), "dst"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Which edges (u, v) among n nodes make a forest with the same components.

    In each round every component takes one edge to a component with a smaller label, which cannot close a circle; then labels are followed to their ends.
    """
    label, kept = np.arange(n), []
    while len(open_ := np.flatnonzero(label[u] != label[v])):
        low, high = np.minimum(label[u[open_]], label[v[open_]]), np.maximum(label[u[open_]], label[v[open_]])
        own, first = np.unique(high, return_index=True)
        kept.append(open_[first])
        label[own] = low[first]
        while (label != label[label]).any():
            label = label[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def links(vectors: DataFrame, least: float, *, block_rows: int = 4096, connect: bool = False) -> DataFrame:
    """(a, b, sim), a < b: all pairs of `vectors` (id, vec) with a cosine of `least` or more; no neighbour list is cut.

    With `connect`, each pair of blocks gives only the links of a forest: at most one fewer than its rows, with the
    same connected components as all of them.
    """
    blocks = max(1, -(-vectors.count() // block_rows))
    left, right = (_dealt(vectors, blocks, blocks, side, *keys) for side, keys in (("l", "xy"), ("r", "yx")))
    left, right = left.where("l_x <= l_y"), right.where("r_x <= r_y")

    def find(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})
        m, n = (np.stack([np.asarray(v, np.float64) for v in s]) for s in (p["l_vec"], q["r_vec"]))
        m, n = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (m, n))
        sims, x, y = m @ n.T, p["l_id"].to_numpy(), q["r_id"].to_numpy()
        i, j = np.nonzero((sims >= least) & ((x[:, None] < y) if p["l_x"].iloc[0] == p["l_y"].iloc[0] else (x[:, None] != y)))
        sim = sims[i, j]
        if connect:
            ids, ends = np.unique(np.concatenate((x[i], y[j])), return_inverse=True)
            keep = forest(ends[: len(i)], ends[len(i) :], len(ids))
            i, j, sim = i[keep], j[keep], sim[keep]
        return pd.DataFrame({"a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j]), "sim": sim})

    return left.groupBy("l_x", "l_y").cogroup(right.groupBy("r_x", "r_y")).applyInPandas(find, "a long, b long, sim double")


def _within(vectors: DataFrame, others: DataFrame, least: float, block_rows: int) -> DataFrame:
    """(node): the ids of `others` with a cosine of `least` or more to any of `vectors`; one row for each and pair of blocks at most."""
    nl, nr = (max(1, -(-side.count() // block_rows)) for side in (vectors, others))
    a, b = _dealt(vectors, nl, nr, "l", "x", "y"), _dealt(others, nr, nl, "r", "y", "x")

    def find(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"node": []}).astype("int64")
        m, n = (_unit(s) for s in (p["l_vec"], q["r_vec"]))
        return pd.DataFrame({"node": q["r_id"][((n @ m.T) >= least).any(1)]})

    return a.groupBy("l_x", "l_y").cogroup(b.groupBy("r_x", "r_y")).applyInPandas(find, "node long").distinct()


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def greedy_representatives(vectors: DataFrame, least: float, *, first: int = 2048, block_rows: int = 4096) -> DataFrame:
    """(node, kept) for `vectors` (id, vec): in a random order (a hash of the id), a vector is kept unless it has a cosine of `least` or more to a kept one before it.

    The order is worked off in batches that double.  What is left of the order after a prefix has few neighbours among itself, even
    in a dense group, because a kept vector takes its neighbours with it; so a batch's own links are few, and what is
    dropped otherwise is a row for each vector, not for each pair.  One task decides the first batch of about `first` rows.
    Rows with a null id or vector are left out.
    """
    rows = vectors.where("id is not null and vec is not null").select("id", "vec", F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h"))
    rows = checkpointed(rows)
    n = rows.count()

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["h", "id"])
        near, free = _unit(p["vec"]), np.ones(len(p), bool)
        for i in range(len(p)):
            if free[i]:
                free[i + 1 :] &= near[i + 1 :] @ near[i] < least
        return p.loc[free, ["id"]]

    left, kept, bound = rows, [], 2**63 * first // max(n, 1)
    while True:
        now = left.where(F.col("h") < min(bound, 2**63 - 1)) if bound < 2**63 else left
        if not kept:
            chosen = now.groupBy().applyInPandas(solve, "id long")
        else:
            pairs = links(now.select("id", "vec"), least, block_rows=block_rows)
            order = now.select("id", F.struct("h", "id").alias("o"))
            placed = pairs.join(order.toDF("a", "oa"), "a").join(order.toDF("b", "ob"), "b")
            turned = placed.select(F.when(F.col("oa") < F.col("ob"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("oa") < F.col("ob"), F.col("b")).otherwise(F.col("a")).alias("b"))
            chosen = greedy_keep(turned, now.select(F.col("id").alias("node"))).where("kept").select(F.col("node").alias("id"))
        new = checkpointed(now.join(chosen, "id", "left_semi").select("id", "vec"))
        kept.append(new.select(F.col("id").alias("node")))
        if bound >= 2**63:
            break
        later = left.where(F.col("h") >= bound)
        left = checkpointed(later.join(_within(new, later, least, block_rows).withColumnRenamed("node", "id"), "id", "left_anti"))
        bound *= 2
    chosen = reduce(DataFrame.unionByName, kept).withColumn("kept", F.lit(True))
    return rows.select(F.col("id").alias("node")).join(chosen, "node", "left").select("node", F.coalesce("kept", F.lit(False)).alias("kept"))


def leakage(docs: DataFrame, holdout: DataFrame, threshold: float, **options) -> DataFrame:
    """(src, dst, sim, leaked): the nearest holdout vector of each document."""
    return top_k(docs, holdout, 1, **options).select("src", "dst", "sim", (F.col("sim") > threshold).alias("leaked"))


def connectivity(neighbours: DataFrame) -> DataFrame:
    """(src, con): mean similarity to the neighbours."""
    return neighbours.groupBy("src").agg(F.avg("sim").alias("con"))

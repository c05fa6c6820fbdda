"""Approximate nearest neighbours by inverted lists.

Centroids are fitted on a bounded sample, every vector goes to the list of its
nearest centroid, and a query visits the lists of its nearest few.  How many is
measured: the fewest that find a wanted share of the true neighbours within the
sample, where neighbours are farther apart than among all vectors.

A list is dealt into blocks of bounded size, so that a list with many vectors
makes more tasks, not larger ones.  Exact search is in `similarity`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows compared with all lists, or with the whole sample, at once.
RUN = 512


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, np.float64) for v in vectors]))


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first, ties by column."""
    return np.argsort(-np.round(sims, 12), axis=1, kind="stable")[:, :k]


def _runs(m: np.ndarray) -> list[np.ndarray]:
    """Rows in runs of bounded size, so that their similarities to all lists are too."""
    return [m[i : i + RUN] for i in range(0, len(m), RUN)]


def _nearest(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(some @ centroids.T, axis=1) for some in _runs(m)])


@dataclass
class Lists:
    """Unit centroids, and how many lists a query visits."""

    centroids: np.ndarray
    probes: int

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors, self.centroids)

    def visit(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([_best(some @ self.centroids.T, self.probes) for some in _runs(vectors)])


def fit_lists(vectors: DataFrame, k: int, *, lists: int | None = None, sample_rows: int = 32_768, rounds: int = 8, recall: float = 0.95, seed: int = 5) -> Lists | None:
    """Lists for `vectors` (id, vec), fitted on the `sample_rows` rows with the smallest hashes of their ids.

    There are as many lists as the square root of the rows, an eighth of the sample at most.  None for an empty table.
    """
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows).select("vec").toPandas()["vec"]
    if not n:
        return None
    m = _matrix(sample)
    lists = max(1, min(lists or round(n**0.5), len(m) // 8 or 1))
    centroids = m[:lists].copy()
    for _ in range(rounds):
        own = _nearest(m, centroids)
        order = np.argsort(own, kind="stable")
        some, first = np.unique(own[order], return_index=True)
        centroids[some] = _unit(np.add.reduceat(m[order], first))
    found = Lists(centroids, lists)
    asked, most = m[:512], min(k, len(m) - 1)

    def truth(start: int) -> np.ndarray:
        sims = asked[start : start + 64] @ m.T
        sims[np.arange(len(sims)), start + np.arange(len(sims))] = -np.inf
        return _best(sims, most)

    true = np.concatenate([truth(i) for i in range(0, len(asked), 64)])
    if true.size:
        place = np.argsort(found.visit(asked), axis=1)  # of each list in a query's order
        seen = np.sort(np.take_along_axis(place, found.assign(m)[true], 1).ravel())
        found.probes = int(seen[min(len(seen) - 1, int(np.ceil(recall * len(seen))) - 1)]) + 1
    return found


def approximate_top_k(queries: DataFrame, data: DataFrame, k: int, *, block_rows: int = 4096, **fit) -> DataFrame:
    """(src, dst, sim, rank) as of `similarity.top_k`, for each query (id, vec) among the data of the lists that it visits.

    Never the query itself; ties go to the smaller id.  Rows with a null id or vector are left out, repeated ids count
    as often as they occur.  Options are those of `fit_lists`.
    """
    queries, data = (side.select("id", "vec").where("id is not null and vec is not null") for side in (queries, data))
    schema = "src long, dst long, sim double"
    lists = fit_lists(data, k, **fit)
    if lists is None:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")

    def assign(batches):
        for p in batches:
            if len(p):
                yield p.assign(list=lists.assign(_matrix(p["vec"])))

    def visit(batches):
        for p in batches:
            if len(p):
                visited = lists.visit(_matrix(p["vec"]))
                yield p.loc[p.index.repeat(visited.shape[1])].assign(list=visited.ravel())

    kind = dict(data.dtypes)["vec"]
    listed = data.mapInPandas(assign, f"id long, vec {kind}, list long")
    asking = queries.mapInPandas(visit, f"id long, vec {kind}, list long")
    # One row for each list, of which there are a bounded number.
    sizes = listed.groupBy("list").count().withColumn("blocks", F.ceil(F.col("count") / block_rows)).select("list", "blocks")
    turns = asking.groupBy("list").count().withColumn("turns", F.ceil(F.col("count") / block_rows)).select("list", "turns")
    plan = F.broadcast(sizes.join(turns, "list"))

    def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
        rows = side.join(plan, "list").withColumn(f"own_{mine}", F.pmod(F.xxhash64("id"), F.col(mine)))
        return rows.withColumn(f"own_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("list", "own_turns", "own_blocks", "id", "vec")

    def best(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"src": [], "dst": [], "sim": []}).astype({"src": "int64", "dst": "int64", "sim": "float64"})
        q = q.sort_values("id")
        sims, ids, dst = _matrix(p["vec"]) @ _matrix(q["vec"]).T, p["id"].to_numpy(), q["id"].to_numpy()
        sims[ids[:, None] == dst[None]] = -np.inf
        order = _best(sims, k)
        found = np.take_along_axis(sims, order, 1)
        fine = np.isfinite(found)
        return pd.DataFrame({"src": np.repeat(ids, order.shape[1])[fine.ravel()], "dst": dst[order][fine], "sim": found[fine]})

    keys = ["list", "own_turns", "own_blocks"]
    pairs = dealt(asking, "turns", "blocks").groupBy(*keys).cogroup(dealt(listed, "blocks", "turns").groupBy(*keys)).applyInPandas(best, schema)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("sim", 12).desc(), "dst"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)

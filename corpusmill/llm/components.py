"""Connected components of an edge table by alternating large and small stars.

Each round is a few grouped minima and joins on long columns; no edge list,
component or label map leaves the executors.  A hub of any degree is reduced by
partial aggregation, and its join rows can be split by adaptive execution.
Tasks first reduce their own edges, a bounded number each, to a forest of stars;
where there are no more than `block` edges, one task has them all and that is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, checkpointed


def _stars(most: int):
    """Edges (u, v) in blocks of little over `most` nodes, each as stars: every node of a component with its smallest one."""

    def root(parent: dict[int, int], n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    def flush(parent: dict[int, int]) -> pa.RecordBatch:
        pairs = [(n, r) for n in parent if (r := root(parent, n)) != n]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((root(parent, parent.setdefault(u, u)), root(parent, parent.setdefault(v, v))))
                parent[high] = low
            if len(parent) > most:
                yield flush(parent)
                parent = {}
        yield flush(parent)

    return run


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, block: int = 1 << 15) -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node.  Loops and nulls are ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpointed(e)
    tasks = ceil_div(e.count(), block) or 1
    e = checkpointed(e.coalesce(tasks).mapInArrow(_stars(2 * block), "u long, v long"))
    before = _state(e)
    for _ in range(max_rounds if tasks > 1 else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minima(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(_minima(large), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p")).select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).where("u <> v").distinct()
        e = checkpointed(small)
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        if tasks > 1:
            raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

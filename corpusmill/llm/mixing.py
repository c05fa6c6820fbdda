"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its
documents should get on average.  The whole part is certain; the fractional
parts are rounded together: two documents of a source exchange words, in a
random direction whose odds keep both expectations, until one of them is
integral.  The source's words stay exactly what they were, so only the last
document left open can move the total, by less than its own size; documents go
from the largest down, so that it is a small one.

Blocks of rows are rounded independently.  Each leaves one open document for a
source at most, and a reduction tree of fan-in `fan` rounds those on.  All random
numbers are hashes of the document id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, shuffle_partitions
from .wordhash import mix

#: A fraction closer than this to 0 or 1 counts as integral.
EPS = 1e-12


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target): shares of the total by weight, none above `most` times its size.

    `sizes` has one row for each source.  Weights repeat over the sources by code
    point, null last.  Capped excess is reshared by weight until none is above:
    with level t, target = min(cap, t * weight), and t is found by taking
    sources in the order in which they reach their caps.  The windows hold one row a source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full_at", "place")
    s = sizes.withColumn("place", F.row_number().over(place) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy())).withColumn("weights", F.sum("weight").over(Window.partitionBy()))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("turn", F.row_number().over(fill))
    s = s.withColumn("t", F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.col("turn"))).over(Window.partitionBy()))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("t") * F.col("weight"), F.col("cap"))).alias("target"))


def _settle(level: int, last: bool, seed: int):
    def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64), seed * 1009 + 31 * level + salt) >> np.uint64(11)) / 2.0**53

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        share, size = rows["share"].to_numpy(copy=True), rows["size"].to_numpy()
        chance, final = uniform(rows["key"].to_numpy(), 1), uniform(rows["key"].to_numpy(), 2)
        for _, own in rows.groupby("source", sort=False, dropna=False).indices.items():
            i = -1
            for j in own:
                if not EPS < share[j] < 1 - EPS:
                    share[j] = round(share[j])
                    continue
                if i < 0:
                    i = j
                    continue
                a, b = size[i], size[j]
                up, down = min(a * (1 - share[i]), b * share[j]), min(a * share[i], b * (1 - share[j]))
                if chance[j] * (up + down) < down:
                    share[i], share[j] = share[i] + up / a, share[j] - up / b
                else:
                    share[i], share[j] = share[i] - down / a, share[j] + down / b
                closed = [k for k in (i, j) if not EPS < share[k] < 1 - EPS]
                for k in closed:
                    share[k] = round(share[k])
                i = next((k for k in (i, j) if k not in closed), -1)
            if last and i >= 0:
                share[i] = float(final[i] < share[i])
        return rows.assign(share=share).drop(columns="shard")

    return run


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 7, block_rows: int = 10_000, fan: int = 16) -> DataFrame:
    """(id_col, source_col, size, source_size, target, copies, taken) for each row of `docs`.

    Size is the number of words; a null text has none.  Sources by code point, null
    last, get `weights` in turn; see `targets` for the shares.  `copies` is a whole
    number, `most` rounded up at most, with mean target / source_size over the
    documents of a source; `taken` is copies times size.  Documents without
    words get no copies.  Rows of equal id, source and size get equal copies;
    null ids are an id.  An empty table gives no rows.  Other columns play no part.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(text_col, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")))
    goal = checkpointed(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    blocks = max(1, -(-rows.count() // block_rows))
    per_doc = rows.where("size > 0").groupBy("id", "source", "size").agg(F.count("*").alias("times"))
    state = per_doc.join(goal, per_doc.source.eqNullSafe(goal.source)).select(
        "id", per_doc.source, (F.col("size") * F.col("times")).alias("size"), F.col("size").alias("each"), (F.col("target") / F.col("source_size")).alias("rate"), F.xxhash64("id", "size").alias("key")
    )
    state = state.withColumn("share", F.col("rate") - F.floor("rate")).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    kinds = dict(state.dtypes)
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    done = []
    level = 0
    while True:
        last = blocks == 1
        # Beyond the first level a source's rows stay together, and sources are spread.
        keys = ["block"] if level == 0 and not last else ["block", "shard"]
        grouped = state.withColumn("shard", F.pmod(F.xxhash64("source"), F.lit(64)))
        state = checkpointed(grouped.repartition(max(blocks, shuffle_partitions(spark)), *keys).groupBy(*keys).applyInPandas(_settle(level, last, seed), schema))
        if last:
            done.append(state)
            break
        done.append(state.where("share in (0.0, 1.0)"))
        blocks = -(-blocks // fan)
        state = state.where("share not in (0.0, 1.0)").withColumn("block", F.floor(F.col("block") / fan))
        level += 1
    rounded = done[0]
    for more in done[1:]:
        rounded = rounded.unionByName(more)
    rounded = rounded.select(F.col("id").alias("r_id"), F.col("source").alias("r_source"), F.col("each").alias("r_size"), (F.floor("rate") + F.col("share")).cast("long").alias("copies"))
    out = rows.join(rounded, F.col("id").eqNullSafe(F.col("r_id")) & rows.source.eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size")), "left").select("id", rows.source, "size", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))
    out = out.join(goal, out.source.eqNullSafe(goal.source)).select(F.col("id").alias(id_col), out.source.alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    return out

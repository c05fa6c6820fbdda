"""Joins on the first of several keys that finds a partner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(left: DataFrame, right: DataFrame, row: str, left_keys: Sequence[Column], right_keys: Sequence[Column], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """`left` with `values` of its best partner in `right`, and `matched_by`, the number of the key that found it (from 1; null where none does).

    Key 1 is tried before key 2, and so on.  Of the rows of `right` that share a key the first in `order` counts.  Null
    and empty keys match nothing.  Each row of `left`, which column `row` must tell apart, comes back once.

    Keys become rows with their number.  `right` has one row for each key before the join, so that a common key
    multiplies nothing and a hot one is split by adaptive execution.
    """

    def keyed(keys: Sequence[Column]) -> Column:
        every = F.array(*[F.struct(F.lit(i).alias("n"), k.cast("string").alias("key")) for i, k in enumerate(keys, 1)])
        return F.explode(F.filter(every, lambda x: x["key"].isNotNull() & (x["key"] != "")))

    best = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)]))
    known = right.select(*dict.fromkeys([*order, *values]), keyed(right_keys).alias("k")).groupBy("k.n", "k.key").agg(best.alias("best"))
    asked = left.select(F.col(row).alias("__row"), keyed(left_keys).alias("k")).select("__row", "k.n", "k.key")
    found = asked.join(known, ["n", "key"]).groupBy("__row").agg(F.min(F.struct("n", "best")).alias("found"))
    out = left.join(found, left[row] == found["__row"], "left")
    return out.select(*[left[c] for c in left.columns], F.col("found.n").alias("matched_by"), *[F.col(f"found.best.v{i}").alias(c) for i, c in enumerate(values)])

"""Selection: quotas, fractions, samples, splits and curves by window functions.

Every random order is the MD5 of an id and a seed, so that reruns and other engines agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import draw, in_random_order, running_total


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def cap_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    return ranked(df, by, order, "__rank").where(F.col("__rank") <= cap).drop("__rank")


def top_fraction(df: DataFrame, by: Sequence[str], order: Sequence[Column], fraction: float) -> DataFrame:
    """The first share of each group, one row at least."""
    n = F.count("*").over(Window.partitionBy(*by))
    out = ranked(df, by, order, "__rank").withColumn("__n", n)
    return out.where(F.col("__rank") <= F.greatest(F.lit(1), F.floor(F.col("__n") * fraction))).drop("__rank", "__n")


def mass_fraction(df: DataFrame, by: Sequence[str], order: Sequence[Column], mass: Column, fraction: float) -> DataFrame:
    """Rows in order until their mass reaches the fraction of the group's; the row that crosses is in."""
    placed = running_total(df.withColumn("__m", mass), order, F.col("__m"), "__before", by=by).withColumn("__by", F.struct(*by))
    total = placed.groupBy("__by").agg(F.sum("__m").alias("__all"))
    return placed.join(total, "__by").where(F.col("__before") < F.col("__all") * fraction).select(*df.columns)


def proportional_quota(df: DataFrame, by: str, order: Sequence[Column], total: int, floor: int, ceiling_share: float, trim: bool = False) -> DataFrame:
    """Rows of each group in proportion to its size, between `floor` (or the group) and a share of the total.

    Floors can make these more than `total`; with `trim`, only the first `total` in order are left.  No quota is above the ceiling, which bounds what is ranked across tasks."""
    sizes = df.groupBy(by).agg(F.count("*").alias("__n"))
    all_ = Window.partitionBy()
    wish = F.floor(F.col("__n") * total / F.sum("__n").over(all_))
    ceiling = int(total * ceiling_share)
    quota = sizes.select(by, F.least("__n", F.least(F.greatest(wish, F.lit(floor)), F.lit(ceiling))).alias("__quota"))
    first = ranked(df, [by], order, "__rank").where(F.col("__rank") <= ceiling)
    out = first.join(quota, by).where("__rank <= __quota").select(*df.columns)
    return out.orderBy(*order).limit(total) if trim else out


def split_exact(df: DataFrame, key: Column, share: float, seed: int) -> DataFrame:
    """Add `part`: 'train' for exactly floor(n * share) rows, the first in a random order, 'valid' for the others."""
    n = df.count()
    placed = in_random_order(df, key, seed, "__place")
    return placed.select(*df.columns, F.when(F.col("__place") < math.floor(n * share), "train").otherwise("valid").alias("part"))


def stratified(df: DataFrame, by: Sequence[str], key: Column, n: int, seed: int) -> DataFrame:
    return cap_per_group(df, by, [draw(key, seed)], n)


def every_nth(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, with_last: bool = True) -> DataFrame:
    """Rows 1, n+1, 2n+1, ... of each group, and its last."""
    total = F.count("*").over(Window.partitionBy(*by))
    out = ranked(df, by, order, "__rank").withColumn("__n", total)
    pick = (F.col("__rank") - 1) % n == 0
    return out.where(pick | (F.col("__rank") == F.col("__n")) if with_last else pick).drop("__rank", "__n")


def valid_prefix(df: DataFrame, by: Sequence[str], order: Sequence[Column], valid: Column, least: int = 1) -> DataFrame:
    """Rows of each group up to its first invalid one; groups with fewer than `least` of them go."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__bad", F.sum(F.when(valid, 0).otherwise(1)).over(run)).where("__bad = 0")
    return out.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where(F.col("__n") >= least).drop("__bad", "__n")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each group in ascending `order`."""
    return ranked(df, by, [c.desc() for c in order], "__rank").where("__rank = 1").drop("__rank")


def copies_for_share(base: int, extra: int, share: float) -> int:
    """Copies of an extra corpus that give it the share of the mix."""
    return -(-int(round(share / (1 - share) * base)) // extra) if extra else 0

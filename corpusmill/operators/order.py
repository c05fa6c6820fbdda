"""Total orders without a task that sees all rows: running totals, shuffles, and tables written in order.

Rows are range-partitioned by the order; totals run within parts, and the totals
of whole parts (one number for each) are added to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def draw(key: Column, seed: int | str) -> Column:
    """A reproducible random key."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def running_total(df: DataFrame, order: Sequence[Column], size: Column, name: str, parts: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """`df` with the sum of `size` over all rows before each in `order`, of its group in `by` if that is given.

    The order should be total; rows that tie in it come in any order among themselves.  Null sizes count as 0, a null
    is a group.  `parts` is the number of range partitions; results do not depend on it.  A group of any size spreads over them.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(*by) if by else F.lit(0)
    sized = df.withColumns({"__size": F.coalesce(size, F.lit(0)).cast("long"), "__by": group})
    # Written once, so that a part that is computed again cannot get other rows.
    dealt = checkpointed(sized.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("__by", "__part").agg(F.sum("__size").alias("__n")).select("__by", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    within = F.sum("__size").over(Window.partitionBy("__by", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("__within", F.coalesce(within, F.lit(0))).join(shift, ["__by", "__part"])
    return placed.select(*df.columns, (F.col("__within") + F.col("__shift")).alias(name))


def ring(df: DataFrame, by: Sequence[str], order: Sequence[Column], key: str, name: str) -> DataFrame:
    """(key, name): for each row the key of the next row of its group in `order`; the last row's next is the first.

    A row alone in its group has no next one and is left out.
    """
    placed = checkpointed(running_total(df, order, F.lit(1), "__at", by=by).select(F.struct(*by).alias("__by") if by else F.lit(0).alias("__by"), key, "__at"))
    sizes = placed.groupBy("__by").agg(F.count("*").alias("__n")).where("__n > 1")
    here = placed.join(sizes, "__by").select("__by", key, F.pmod(F.col("__at") + 1, F.col("__n")).alias("__at"))
    return here.join(placed.withColumnRenamed(key, name), ["__by", "__at"]).select(key, name)


def in_random_order(df: DataFrame, key: Column, seed: int, name: str = "place", parts: int | None = None) -> DataFrame:
    """`df` with each row's place (from 0) in a random order of all rows, the same on every run; `key` names a row."""
    order = [draw(key, seed), key]
    return running_total(df, order, F.lit(1), name, parts)


def in_shuffled_chunks(df: DataFrame, order: Sequence[Column], key: Column, chunk: int, seed: int, name: str = "place", parts: int | None = None) -> DataFrame:
    """`df` with each row's place if every `chunk` consecutive rows in `order` are shuffled among themselves; no row moves farther."""
    placed = running_total(df, order, F.lit(1), "__at", parts).withColumn("__chunk", F.floor(F.col("__at") / chunk))
    rank = F.row_number().over(Window.partitionBy("__chunk").orderBy(draw(key, seed), key)) - 1
    return placed.select(*df.columns, (F.col("__chunk") * chunk + rank).alias(name))


def write_in_order(df: DataFrame, place: str, path: str, files: int, format: str = "parquet") -> None:
    """Write `df` by ascending `place` over `files` files, whose names sort as their rows do."""
    df.repartitionByRange(files, place).sortWithinPartitions(place).write.format(format).save(path)

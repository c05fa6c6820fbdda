"""Documents' token ids as one flat stream: rows of equal length, batches of lanes, and merged stores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running_total
from .tokens import cut_rows


def closed(rows: DataFrame, end: int) -> DataFrame:
    """`rows` with the end token behind each document's `ids`; null ids are none."""
    return rows.withColumn("ids", F.concat(F.coalesce("ids", F.array().cast("array<int>")), F.array(F.lit(end))))


def flat_rows(rows: DataFrame, order: Sequence[Column], length: int, parts: int | None = None) -> DataFrame:
    """(row, ids): the documents' `ids` laid end to end in `order` and cut every `length`; a last, shorter row is dropped.

    Documents cross the borders of rows and of tasks.  A document's offset is a distributed running total; its tokens
    go to the rows they fall in, so that no task has more of the stream than its documents.
    """
    placed = running_total(rows, order, F.size("ids"), "at", parts)
    return cut_rows(placed, length).where(F.size("ids") == length)


def batches(rows: DataFrame, order: Sequence[Column], batch: int, length: int, parts: int | None = None) -> DataFrame:
    """(step, lane, ids): the stream as `batch` lanes that each run on from step to step; what fills no whole step is dropped."""
    flat = flat_rows(rows, order, length, parts)
    total = rows.agg(F.sum(F.size("ids")).alias("n")).select(F.floor(F.coalesce("n", F.lit(0)) / (batch * length)).alias("steps"))  # one row
    kept = flat.crossJoin(F.broadcast(total)).where(F.col("row") < F.col("steps") * batch)
    return kept.select((F.col("row") % F.col("steps")).alias("step"), F.floor(F.col("row") / F.col("steps")).alias("lane"), "ids")


def merged_stores(stores: Sequence[tuple[str, DataFrame]], key: str, vocabulary: int, parts: int | None = None) -> DataFrame:
    """(store, key, start, n_tokens) of several stores of (key, ids), one behind the other, each in the order of its key.

    A store that holds an id of `vocabulary` or more is an error when the rows are made.  Null ids are none.
    """
    tagged = [df.select(F.lit(i).alias("__store"), F.lit(name).alias("store"), key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")) for i, (name, df) in enumerate(stores)]
    rows = reduce(DataFrame.unionByName, tagged)
    beyond = F.coalesce(F.array_max("ids") >= vocabulary, F.lit(False))
    checked = F.when(beyond, F.raise_error(F.concat(F.lit("an id is not in the vocabulary: "), "store", F.lit(" "), F.col(key).cast("string"))).cast("int")).otherwise(F.size("ids"))
    sized = rows.select("__store", "store", key, checked.cast("long").alias("n_tokens"))
    out = running_total(sized, [F.col("__store"), F.col(key).asc_nulls_first(), F.col("n_tokens")], F.col("n_tokens"), "start", parts)
    return out.select("store", key, "start", "n_tokens")

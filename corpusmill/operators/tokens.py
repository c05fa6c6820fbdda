"""Token sequences: windows, streams, packing and guards, on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_list
from .order import in_random_order, running_total


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, ids): the length of each word, as stand-ins for token ids."""
    return docs.select("doc_id", F.transform(word_list(F.col("text")), lambda w: F.length(w)).alias("ids"))


def in_vocabulary(ids: Column, size: int) -> Column:
    """Ids beyond the vocabulary become 0."""
    return F.transform(ids, lambda x: F.when(x >= size, 0).otherwise(x))


def windows(rows: DataFrame, size: int, least: int = 4) -> DataFrame:
    """(doc_id, part, ids): consecutive windows that keep every token, but a tail shorter than `least`."""
    last = F.floor((F.size("ids") - 1) / size)
    parts = rows.where(F.size("ids") > 0).select("doc_id", "ids", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    cut = F.slice("ids", (F.col("part") * size + 1).cast("int"), size)
    return parts.select("doc_id", "part", cut.alias("ids")).where(F.size("ids") >= least)


def streams(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Deal documents in random order to n streams, round robin; adds stream and rank."""
    placed = in_random_order(rows, F.col("doc_id"), seed, "rank")
    return placed.withColumns({"rank": F.col("rank") + 1, "stream": F.col("rank") % n})


def packed(rows: DataFrame, n: int, length: int, end: int, seed: int) -> DataFrame:
    """(stream, block, ids): streams cut into blocks of exactly `length`, each document closed by `end`, the last block padded.

    A document's offset is a distributed running total within its stream; its tokens go to the blocks they fall in, so no stream is held whole.
    """
    dealt = streams(rows, n, seed).withColumn("ids", F.concat("ids", F.array(F.lit(end))))
    placed = running_total(dealt, [F.col("rank")], F.size("ids"), "at", by=["stream"])
    whole = cut_rows(placed, length, ["stream"])
    return whole.select("stream", F.col("row").alias("block"), F.concat("ids", F.array_repeat(F.lit(end), F.lit(length) - F.size("ids"))).alias("ids"))


def cut_rows(placed: DataFrame, length: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, row, ids) from documents with `ids` and their offset `at`: tokens gathered by row of `length`; the last row may be shorter.

    Pieces are cut before rows are made of them, so that a long document is not copied for each.
    """
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.size("ids") - 1) / length)

    def piece(row: Column) -> Column:
        start = F.greatest(F.lit(0).cast("long"), row * length - F.col("at"))
        stop = F.least(F.size("ids").cast("long"), (row + 1) * length - F.col("at"))
        return F.struct(row.alias("row"), (F.col("at") + start).alias("at"), F.slice("ids", (start + 1).cast("int"), (stop - start).cast("int")).alias("ids"))

    pieces = placed.where(F.size("ids") > 0).select(*by, F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select(*by, "p.*")
    whole = pieces.groupBy(*by, "row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))  # `length` tokens at most
    return whole.select(*by, "row", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))

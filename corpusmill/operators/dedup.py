"""Deduplication by keys, leakage by n-grams, and components of similarity graphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gram_hashes, word_list
from ..sources.shared import checkpointed


def first_per_key(df: DataFrame, key: Column, order: Sequence[Column], keep_keyless: bool = False) -> DataFrame:
    """The first row of each key in `order` (which should be total).  Rows with a null key go, or all stay."""
    w = Window.partitionBy("__key").orderBy(*order)
    ranked = df.withColumn("__key", key).where("__key is not null").withColumn("__rank", F.row_number().over(w))
    out = ranked.where("__rank = 1").drop("__key", "__rank")
    return out.unionByName(df.where(key.isNull())) if keep_keyless else out


def prefer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All of `left`, and of `right` what has no row there."""
    return left.unionByName(right.join(left.select(key), key, "left_anti"), allowMissingColumns=True)


def duplicate_counts(df: DataFrame, key: Column) -> DataFrame:
    """(group_size, groups): how many keys have how many rows."""
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("groups"))


def shared_ngrams(docs: DataFrame, references: DataFrame, *, doc_id: str, doc_text: str, ref_text: str, n: int = 8) -> DataFrame:
    """(doc_id, shared): documents with an n-gram of any reference, and how many different ones.

    The join carries two hashes of each n-gram; only what both sides have is made distinct.
    """

    def hashes(rows: DataFrame, text: str, *keep: str) -> DataFrame:
        # The words are a column of their own: inside the lambda they would be split again for each n-gram.
        words = rows.select(*keep, word_list(F.lower(text)).alias("w")).where(F.size("w") >= n)
        return words.select(*keep, F.explode(gram_hashes(F.col("w"), n)).alias("g")).select(*keep, "g.a", "g.b")

    known = hashes(references, ref_text).distinct()
    mine = hashes(docs, doc_text, doc_id)
    return mine.join(known, ["a", "b"], "left_semi").distinct().groupBy(doc_id).agg(F.count("*").alias("shared"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges (a < b) with the larger similarity of both directions; no loops."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("sim").alias("sim"))


def components(edges: DataFrame, nodes: DataFrame, checkpoint, max_rounds: int = 50) -> DataFrame:
    """(node, component) by propagating the smallest label and following labels; `checkpoint` cuts the lineage of each round."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    both = checkpoint(both)
    labels = checkpoint(nodes.select("node", F.col("node").alias("component")))
    for _ in range(max_rounds):
        offered = both.join(labels, F.col("y") == F.col("node")).groupBy(F.col("x").alias("node")).agg(F.min("component").alias("offer"))
        lower = labels.join(offered, "node", "left").select("node", F.least("component", "offer").alias("component"), (F.col("offer") < F.col("component")).alias("moved"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = checkpoint(lower.join(target, "component", "left").select("node", F.least("component", "further").alias("component"), "moved"))
        moved = jumped.where("moved").limit(1).count()
        labels = jumped.select("node", "component")
        if not moved:
            return labels
    raise RuntimeError("components did not converge")


def greedy_keep(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, kept) of the sequential rule "keep a node unless a kept neighbour comes before it"; edges are (a, b), a before b.

    In each round the nodes without an undecided neighbour before them are kept and their neighbours are dropped, with
    all their edges, until no edge is left.  Every round decides a node, so it ends; if the order is random, a few
    rounds do (a logarithm), while a chain that is linked in order takes half as many as it has nodes.  No component or
    neighbourhood is held by one task.
    """
    left, gone = checkpointed(edges.select("a", "b").distinct()), []
    while left.limit(1).count():
        first = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        drop = checkpointed(left.join(first, "a", "left_semi").select(F.col("b").alias("node")).distinct())
        gone.append(drop)
        for end in ("a", "b"):
            left = left.join(drop.withColumnRenamed("node", end), end, "left_anti")
        left = checkpointed(left.select("a", "b"))
    dropped = reduce(DataFrame.unionByName, gone, nodes.select("node").limit(0)).withColumn("gone", F.lit(True))
    return nodes.join(dropped, "node", "left").select("node", F.col("gone").isNull().alias("kept"))


def cap_degrees(edges: DataFrame, cap: int, checkpoint, max_rounds: int = 100) -> DataFrame:
    """The edges (a, b, sim) that remain if they are taken by falling similarity (ties: a, then b) while both ends have fewer than `cap`.

    An edge among the best of both its ends, as many as these may still take, is taken by
    the sequential rule too; so each round takes all of those at once and drops the edges of full ends.
    """
    order = [F.col("sim").desc(), F.col("a"), F.col("b")]
    left, taken = checkpoint(edges.select("a", "b", "sim")), None
    used = None
    for _ in range(max_rounds):
        if used is not None:  # drop the edges of full ends, so that they take no rank
            full = used.where(F.col("used") >= cap).select("node")
            for end in ("a", "b"):
                left = left.join(full.withColumnRenamed("node", end), end, "left_anti")
            left = checkpoint(left.select("a", "b", "sim"))
        if not left.limit(1).count():
            break
        ends = left.select(F.col("a").alias("node"), "a", "b", "sim").unionByName(left.select(F.col("b").alias("node"), "a", "b", "sim"))
        ends = ends.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(*order)))
        ends = ends.withColumn("free", F.lit(cap)) if used is None else ends.join(used, "node", "left").withColumn("free", cap - F.coalesce("used", F.lit(0)))
        both = checkpoint(ends.groupBy("a", "b", "sim").agg(F.min((F.col("rank") <= F.col("free")).cast("int")).alias("take")))
        now = both.where("take = 1").select("a", "b", "sim")
        taken = checkpoint(now if taken is None else taken.unionByName(now))
        used = taken.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("used"))
        left = both.where("take = 0").select("a", "b", "sim")
    else:
        raise RuntimeError("the edges did not settle")
    return edges.limit(0).select("a", "b", "sim") if taken is None else taken

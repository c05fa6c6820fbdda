"""Cleaning of held-out items at the level of their source documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gram_hashes, word_list
from ..sources.shared import checkpointed
from .dedup import components


def shared_passages(items: DataFrame, docs: DataFrame, *, item: str, item_text: str, doc: str, doc_text: str, n: int = 8) -> tuple[DataFrame, DataFrame]:
    """((item, a, b), (doc, a, b)): the n-grams of words that items and documents have in common, each as two hashes."""
    gram = ["a", "b"]

    def grams(rows: DataFrame, key: str, text: str) -> DataFrame:
        words = rows.select(F.col(key).alias("id"), word_list(F.lower(text)).alias("w")).where(F.size("w") >= n)
        return words.select("id", F.explode(gram_hashes(F.col("w"), n)).alias("g")).select("id", "g.a", "g.b")

    mine = checkpointed(grams(items, item, item_text).distinct())
    theirs = checkpointed(grams(docs, doc, doc_text).join(mine.select(*gram).distinct(), gram, "left_semi").distinct())
    return mine.join(theirs.select(*gram).distinct(), gram, "left_semi"), theirs


def clean_holdout(items: DataFrame, docs: DataFrame, in_training: Column, *, item: str, item_text: str, doc: str, doc_text: str, n: int = 8) -> DataFrame:
    """(item, group, leaked): items that share passages, through documents however many, form a group, named by its smallest item.

    A group leaks as a whole if any of its documents is in training.  A passage (n-gram) ties all that have it to its
    smallest item, and a document its passages' items to the smallest of them; so the graph has items only, and a
    passage or document that many share makes a star, not all pairs.  Items without a common passage are groups of their own.
    """
    mine, theirs = shared_passages(items, docs, item=item, item_text=item_text, doc=doc, doc_text=doc_text, n=n)
    first = mine.groupBy("a", "b").agg(F.min("id").alias("first"))
    links = checkpointed(theirs.join(first, ["a", "b"]).select("id", "first").distinct())
    lowest = links.groupBy("id").agg(F.min("first").alias("low"))
    edges = mine.join(first, ["a", "b"]).select(F.col("id").alias("a"), F.col("first").alias("b")).unionByName(links.join(lowest, "id").select(F.col("first").alias("a"), F.col("low").alias("b")))
    nodes = items.select(F.col(item).alias("node")).distinct()
    labels = checkpointed(components(edges.where("a <> b").distinct(), nodes, checkpointed))
    training = docs.where(in_training).select(F.col(doc).alias("id"))
    seen = links.join(training, "id", "left_semi").select(F.col("first").alias("node")).distinct()
    bad = labels.join(seen, "node").select("component").distinct().withColumn("leaked", F.lit(True))
    out = labels.join(bad, "component", "left")
    return out.select(F.col("node").alias(item), F.col("component").alias("group"), F.coalesce("leaked", F.lit(False)).alias("leaked"))

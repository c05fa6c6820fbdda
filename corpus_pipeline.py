"""A corpus pipeline of five stages, each (spark, docs, sf_dir) -> DataFrame over all that the one before kept.

Quality rules, near-deduplication, substring deduplication, mixing to target
weights, and encoding.  All but the last return the columns of `documents`; a
document that the mix takes more than once comes back so many times.  ORACLE_SQL
is None: rounding, rule learning and BPE have no SQL form.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.byte_bpe import bpe_encode
from corpusmill.llm.common import checkpointed, table
from corpusmill.llm.mixing import mix_sources
from corpusmill.llm.near_dedup import near_dedup
from corpusmill.llm.quality_rules import base_failed, learn_from_labels, text_statistics
from corpusmill.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the learned list reject.

    Texts are read once: rows and their statistics are kept together until the rules are known.  Null, empty and
    blank texts fail the base rules; rows with a null id, repeated rows and other columns pass like any other.
    """
    stats = checkpointed(text_statistics(docs, whole_row="__row"))
    rules = learn_from_labels(docs, table(spark, sf_dir, "labels"), stats=stats)
    return stats.where(~base_failed() & rules.verdict()).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies (five-word shingles, similarity 0.8).

    Rows that repeat an id are one document: it links with the copies of any of its texts, and if it stays each of its
    different texts does, once.  Texts without words are copies of nothing, nor are rows with a null id, which all stay.
    An empty table stays empty; other columns pass.
    """
    kept = near_dedup(docs, width=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    one = F.min_by(F.struct(*docs.columns), F.struct("lang", "source")).alias("row")
    rows = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id", F.sha2("text", 256)).agg(one).select("row.*")
    return rows.unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words inside 20-word windows that occur earlier; texts become their kept words joined by a space.

    Every row comes back once.  A null text becomes an empty one; of repeated rows the copies are cut whole.
    """
    out = substring_dedup(docs, keep=["lang", "source"])
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix has it, three times at most.

    Texts without words are never taken.  Rows that agree in id, source and size get equal copies; a null id is an id.
    Other columns pass, whatever their names; an empty table stays empty.
    """
    mix = mix_sources(docs).where("copies > 0").select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "copies").distinct()
    size = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), size.alias("size"))
    taken = rows.join(mix, rows.id.eqNullSafe(mix.m_id) & rows.of.eqNullSafe(mix.m_source) & (rows.size == mix.m_size))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it.  A null text has none."""
    out = bpe_encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded")
    same = F.col("decoded") == F.to_binary(F.coalesce("text", F.lit("")), F.lit("utf-8"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixture", mixture), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

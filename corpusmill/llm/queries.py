"""Queries of this subpackage: op<N>_<name>(spark, sf_dir) with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_encode
from .chroma import align
from .common import checkpointed, shared_folder, table
from .language_id import predict_language, train_language_model
from .mixing import mix_sources
from .near_dedup import near_dedup
from .pitman_yor import hpy_scores
from .prefix_trie import numbered, prefix_trie, with_shared_heads
from .quality_rules import quality_rules
from .sql import ORACLE_SQL  # noqa: F401
from .substring_dedup import substring_dedup
from .token_files import file_documents, write_token_files
from .token_transducer import token_counts
from .toxicity import flag_toxic, predict_severity, split_grades, train_severity, training_rows
from .vector_codes import codebooks_sha256, vector_codes

#: Vocabulary files of the public tokenizers on this machine; a parameter of the operators.
TIKTOKEN, JSON, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    out = hpy_scores(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts' bytes are played as 8-bit samples; every twentieth id asks for its best alignment among all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_binary("text", F.lit("utf-8")).alias("audio"))
    return align(docs, F.col("doc_id") % 20 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (not toxic), 1 and 2 (toxic, below and above the median score of a first fit on two grades)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    rows = training_rows(docs.join(labels, F.col("doc_id") == F.col("label_id")), grade=F.col("toxic"), key=F.col("doc_id"))
    two = train_severity(rows, 2)
    model = train_severity(split_grades(rows, two, 3), 3) if two else None
    scored = checkpointed(predict_severity(docs, model).select("doc_id", "severity", "grade"))
    return flag_toxic(scored, labels.where("toxic = 0").select(F.col("label_id").alias("doc_id")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_encode(docs, TIKTOKEN, public_tokenizers.PATTERN, decoded_col="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, JSON)
    return out.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = train_language_model(docs.where("not held_out"), key=F.col("doc_id"))
    return predict_language(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=2, percent=80)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a conv_id belong to no conversation."""
    turns, lengths = with_shared_heads(numbered(table(spark, sf_dir, "conversations")), group=5, heads=9)
    return prefix_trie(turns, lengths)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, WORDS, end=2)
    return file_documents(spark, folder)


QUERIES = {q.__name__: q for q in (op1_substring_dedup, op2_pitman_yor, op3_chroma, op4_toxicity, op5_byte_bpe, op6_quality_rules, op7_token_counts, op8_language_id, op9_mixing, op10_near_dedup, op11_prefix_trie, op12_vector_codes, op13_token_files)}

"""Orders of whole tables: token streams, merged stores, shuffles and atomic rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flat, order, tokens
from ..sources import atomic
from ..sources.io import table
from ..sources.shared import new_folder
from .registry import query

_IDS = "list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: length(x)::int)"
_TOKENS = f"SELECT doc_id, i, id, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM (SELECT doc_id, list_append({_IDS}, 0) AS ids FROM documents))"


@query(f"""WITH t AS MATERIALIZED ({_TOKENS}), n AS (SELECT count(*) // (4 * 64) AS steps FROM t)
SELECT (pos // 64) % steps AS step, (pos // 64) // steps AS lane, list(id ORDER BY pos) AS ids FROM t, n WHERE pos // 64 < steps * 4 GROUP BY 1, 2""")
def flat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' tokens (word lengths, closed by 0) as one stream in four lanes of rows of 64."""
    docs = flat.closed(tokens.word_lengths(table(spark, sf_dir, "documents")), 0)
    return flat.batches(docs, [F.col("doc_id")], 4, 64)


@query(f"""WITH t AS (SELECT CASE WHEN source < 'src5' THEN 'first' ELSE 'second' END AS store, doc_id, len({_IDS})::bigint AS n_tokens FROM documents)
SELECT store, doc_id, coalesce(sum(n_tokens) OVER (ORDER BY store, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start, n_tokens FROM t""")
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of all documents after two stores are laid one behind the other."""
    docs = table(spark, sf_dir, "documents")
    ids = tokens.word_lengths(docs).join(docs.select("doc_id", "source"), "doc_id")
    return flat.merged_stores([("first", ids.where("source < 'src5'")), ("second", ids.where("source >= 'src5'"))], "doc_id", 1 << 20)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':31'), doc_id) - 1 AS place FROM documents")
def global_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.in_random_order(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 31)


@query("""WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS chunk FROM documents)
SELECT doc_id, chunk * 128 + row_number() OVER (PARTITION BY chunk ORDER BY md5(doc_id || ':32'), doc_id) - 1 AS place FROM p""")
def chunk_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 128 documents in a row are shuffled among themselves."""
    return order.in_shuffled_chunks(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], F.col("doc_id"), 128, 32)


@query("SELECT min(doc_id) AS doc_id, md5(text) AS k FROM documents GROUP BY 2")
def atomic_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of keys that is rewritten from itself: the second version has one document for each key."""
    path = new_folder(spark, "keys")
    atomic.rewrite(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k")), path)
    atomic.rewrite(atomic.read(spark, path).groupBy("k").agg(F.min("doc_id").alias("doc_id")), path)
    return atomic.read(spark, path).select("doc_id", "k")

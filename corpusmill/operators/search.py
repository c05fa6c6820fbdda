"""Full-text search over a term table: boolean, prefix and phrase conditions, ranked by BM25."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM = "[\\p{L}\\p{N}]+"


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, size): how often each term occurs in a document of so many terms."""
    listed = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(text_col), F.lit(TERM), F.lit(0)).alias("w"))
    return listed.select("id", F.size("w").alias("size"), F.explode("w").alias("term")).groupBy("id", "term", "size").agg(F.count("*").alias("tf"))


def search(docs: DataFrame, any_of: Sequence[str], *, all_of: Sequence[str] = (), phrase: str | None = None, id_col: str = "doc_id", text_col: str = "text", among: DataFrame | None = None, k: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the best k documents by BM25 over the terms of `any_of` (a trailing * makes a prefix).

    `all_of` must all occur and `phrase` must stand in the text as it is, case aside.  With `among` (id), only these
    documents are ranked, by scores over all.
    Only rows of wanted terms are kept before anything is shuffled; counts of documents and terms are one small aggregate.
    """
    wanted = [*any_of, *all_of]
    match = F.lit(False)
    for t in wanted:
        match = match | (F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t)
    base = docs.where(F.lower(text_col).contains(phrase.lower())) if phrase else docs
    sizes = docs.select(F.regexp_count(F.lower(text_col), F.lit(TERM)).alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    hits = terms(base, id_col, text_col).where(match)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(df, "term").join(sizes, F.lit(True))  # one row on the right
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    every = [F.max((F.col("term") == t).cast("int")).alias(f"has{i}") for i, t in enumerate(all_of)]
    out = scored.groupBy("id").agg(F.sum(part).alias("score"), *every)
    for i in range(len(all_of)):
        out = out.where(f"has{i} = 1")
    if among is not None:
        out = out.join(among, "id", "left_semi")
    return out.select("id", "score").orderBy(F.round("score", 9).desc(), "id").limit(k)

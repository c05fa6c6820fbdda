"""Mutations that only the context can refute: a value in a sentence gives way to another that the same text has before it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structure import sentences
from ..sources.shared import checkpointed


def mentions(docs: DataFrame, kinds: Mapping[str, str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, kind, sentence, place, value): what the pattern of each kind finds in each sentence, in order."""
    parts = docs.select(F.col(id_col).alias("doc"), F.posexplode(sentences(F.coalesce(text_col, F.lit("")))).alias("sentence", "body"))
    found = F.flatten(F.array(*[_found(pattern, kind) for kind, pattern in kinds.items()]))
    return parts.select("doc", "sentence", F.explode(found).alias("m")).select("doc", "m.kind", "sentence", "m.place", "m.value")


def _found(pattern: str, kind: str) -> Column:
    return F.transform(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)), lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), v.alias("value")))


def _last(array: Column) -> Column:
    return F.get(F.reverse(array), 0)


def dictionary(found: DataFrame, least: int) -> DataFrame:
    """(kind, value): what `least` documents mention."""
    return found.select("kind", "value", "doc").distinct().groupBy("kind", "value").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("kind", "value")


def rebound(docs: DataFrame, kinds: Mapping[str, str], open_kinds: set[str], *, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, kind, sentence, old, new, mutated): for each document and kind its last mention that an earlier sentence can replace.

    Kinds are patterns.  Values of kinds outside `open_kinds` count only if `least` documents have them, a dictionary that the
    table itself gives.  The replacement is of the same kind, stands in an earlier sentence, nearest first, and not in
    the sentence itself, whose first place of the old value it takes.  Documents without such a mention give no row.
    """
    found = checkpointed(mentions(docs, kinds, id_col=id_col, text_col=text_col))  # short rows that are read three times
    closed = found.where(~F.col("kind").isin(*open_kinds)) if open_kinds else found
    known = closed.join(dictionary(closed, least), ["kind", "value"], "left_semi").select(found.columns)
    every = known.unionByName(found.where(F.col("kind").isin(*open_kinds))) if open_kinds else known
    # The mentions of one text are as bounded as the text is.
    by_sentence = every.groupBy("doc", "kind", "sentence").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda m: m["value"]).alias("values"))
    whole = by_sentence.groupBy("doc", "kind").agg(F.sort_array(F.collect_list(F.struct("sentence", "values"))).alias("all"))

    def offers(earlier: Column, own: Column) -> Column:
        return (earlier["sentence"] < own["sentence"]) & (F.size(F.array_except(earlier["values"], own["values"])) > 0)

    # The first sentence that offers something ends the search, so a long text costs little more than its mentions.
    chosen = whole.withColumn("own", _last(F.filter("all", lambda own: F.exists("all", lambda x: offers(x, own)))))
    source = _last(F.filter("all", lambda x: offers(x, F.col("own"))))
    new = _last(F.filter(source["values"], lambda v: ~F.array_contains(F.col("own.values"), v)))
    last = chosen.where("own is not null").select("doc", "kind", F.col("own.sentence").alias("sentence"), _last(F.col("own.values")).alias("old"), new.alias("new"))
    texts = docs.select(F.col(id_col).alias("doc"), sentences(F.coalesce(text_col, F.lit(""))).alias("parts"))
    body = F.get("parts", F.col("sentence"))
    at = F.instr(F.col("body"), F.col("old"))
    mutated = F.concat(F.substring("body", F.lit(1), at - 1), "new", F.substring("body", at + F.length("old"), F.length("body")))
    out = last.join(texts, "doc").withColumn("body", body)
    return out.select(F.col("doc").alias(id_col), "kind", "sentence", "old", "new", mutated.alias("mutated"))

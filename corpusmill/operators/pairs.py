"""Contrast pairs: a context, its true continuation and a false one, at four levels; mutations of text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, word_list
from ..sources.shared import checkpointed
from .order import draw, ring

#: Words and what they turn into, fixed values; both directions hold.
SWAPS = [("increase", "decrease"), ("higher", "lower"), ("positive", "negative"), ("before", "after"), ("more", "less"), ("above", "below"), ("cause", "prevent"), ("warm", "cold"), ("dry", "wet"), ("always", "never")]
AUXILIARIES = ("is", "are", "was", "were", "can", "will", "does", "has")


def swap_table(pairs=SWAPS) -> dict[str, str]:
    """Both directions, in order; a word that comes again takes its last partner."""
    out: dict[str, str] = {}
    for a, b in pairs:
        out[a], out[b] = b, a
    return out


def swap(text: str, table: dict[str, str]) -> str | None:
    """The earliest word of the table exchanged, its capital kept."""
    m = re.search(r"\b(" + "|".join(sorted(table, key=len, reverse=True)) + r")(?=s?\b|d\b)", text, re.I)
    if not m:
        return None
    new = table[m[1].lower()]
    return text[: m.start()] + (new.capitalize() if m[1][0].isupper() else new) + text[m.end() :]


def shift_number(text: str) -> str | None:
    """The first number tripled, with its decimals and commas as they were."""
    m = re.search(r"\d[\d,]*(?:\.\d+)?", text)
    if not m:
        return None
    plain = m[0].replace(",", "")
    places = len(plain.partition(".")[2])
    new = f"{float(plain) * 3 + (0 if float(plain) else 1):{',' if ',' in m[0] else ''}.{places}f}"
    return text[: m.start()] + new + text[m.end() :]


def negate(text: str) -> str | None:
    m = re.search(r"\b(" + "|".join(AUXILIARIES) + r")\b(?! not)", text)
    return f"{text[: m.end()]} not{text[m.end() :]}" if m else None


def mutate(text: str, table: dict[str, str]) -> tuple[str | None, str]:
    """The first mutation that applies, with its kind."""
    for kind, f in (("direction", lambda t: swap(t, table)), ("number", shift_number), ("negation", negate)):
        if (new := f(text)) and new != text:
            return new, kind
    return None, "none"


#: The same words by what they say; `mutated_words` tries the tables in this order.
TABLES = {
    "direction": [("increase", "decrease"), ("increased", "decreased"), ("higher", "lower"), ("more", "less"), ("above", "below"), ("positive", "negative")],
    "mechanism": [("activate", "inhibit"), ("promote", "suppress")],
    "environment": [("warm", "cold"), ("dry", "wet")],
    "causal": [("cause", "prevent"), ("because", "although")],
    "temporal": [("before", "after"), ("always", "never")],
}
MARKS = ".,;:!?()\""
PUNCTUATION = f"[{MARKS}]"


def _case(branches) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda c, b: (F if c is None else c).when(*b), branches, None)


def mutated_words(words: Column, tables: Mapping[str, Sequence[tuple[str, str]]] = TABLES, auxiliaries: Sequence[str] = AUXILIARIES) -> Column:
    """struct(kind, place, old, new) of the first mutation of a list of words that applies, or null.

    Kinds come in this order: each table (its earliest word gives way to its partner, either way round, a capital
    stays), "number" (the first whole number is tripled), "digits" (the first number of at least twenty digits becomes
    the next one of the same length), and "negation" (not behind the first auxiliary).  Punctuation around a word stays.
    """
    core = lambda w: F.btrim(w, F.lit(MARKS))
    kinds = [(kind, swap_table(some)) for kind, some in tables.items()]
    number, digits, negation = range(len(kinds), len(kinds) + 3)

    def place_of_kind(old: Column) -> Column:
        """The place of the first kind that applies to a word: a word's later kinds never count, as its first comes before."""
        low = F.lower(old)
        whole = F.when(F.length(old) < 20, number).otherwise(digits)
        return _case([*((low.isin(*table), i) for i, (_, table) in enumerate(kinds)), (old.rlike("^[0-9]+\\z"), whole), (low.isin(*auxiliaries), negation)])

    def swapped(old: Column, table: dict[str, str]) -> Column:
        new = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(old))
        return F.when(old.rlike("^[A-Z]"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)

    def made(f: Column) -> Column:
        old = f["old"]
        news = [(kind, swapped(old, table)) for kind, table in kinds]
        news.append(("number", (old.try_cast("decimal(20,0)") * 3).cast("string")))
        news.append(("digits", F.concat(F.substring(old, F.lit(1), F.length(old) - 1), ((F.right(old, F.lit(1)).try_cast("int") + 1) % 10).cast("string"))))
        news.append(("negation", F.concat(old, F.lit(" not"))))
        pick = lambda values: _case((f["kind"] == i, v) for i, v in enumerate(values))
        return F.struct(pick([F.lit(kind) for kind, _ in news]).alias("kind"), f["place"].alias("place"), old.alias("old"), pick([new for _, new in news]).alias("new"))

    # Each word is looked at once; lambdas over arrays of one element hold what is used twice.
    found = F.transform(F.array(F.transform(words, lambda w: place_of_kind(core(w)))), lambda ks: F.struct(F.array_min(ks).alias("kind"), (F.array_position(ks, F.array_min(ks)) - 1).cast("int").alias("place")))
    found = F.transform(found, lambda f: F.struct(f["kind"].alias("kind"), f["place"].alias("place"), core(F.get(words, f["place"])).alias("old")))
    return F.get(F.transform(F.filter(found, lambda f: f["kind"].isNotNull()), made), 0)


def mutated(rows: DataFrame, words: str, tables: Mapping[str, Sequence[tuple[str, str]]] = TABLES) -> DataFrame:
    """Rows with a mutation of their list of words, as `m`.

    The explode of one element keeps the filter behind it, so that the mutation is not made twice."""
    return rows.select("*", F.explode(F.array(mutated_words(F.col(words), tables))).alias("m")).where("m is not null")


def with_mutation(words: Column, mutation: Column) -> Column:
    """The words with the mutation made; null if there is none."""
    return F.when(mutation.isNotNull(), F.transform(words, lambda w, i: F.when(i == mutation["place"], F.replace(w, mutation["old"], mutation["new"])).otherwise(w)))


def repair_articles(text: Column) -> Column:
    """a before a vowel letter becomes an, and back; by letters, not sounds."""
    text = F.regexp_replace(text, "\\b([Aa]) (?=[aeiouAEIOU])", "$1n ")
    return F.regexp_replace(text, "\\b([Aa])n (?=[^aeiouAEIOU\\W])", "$1 ")


def mutations(rows: DataFrame, text_col: str, pairs=SWAPS) -> DataFrame:
    """Add mutated (null if nothing applies) and kind."""
    table = swap_table(pairs)

    @F.pandas_udf("struct<mutated:string,kind:string>")
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mutate(t or "", table) for t in column], columns=["mutated", "kind"])

    return rows.withColumn("__m", run(text_col)).select(*rows.columns, repair_articles(F.col("__m.mutated")).alias("mutated"), F.col("__m.kind").alias("kind"))


def mates(docs: DataFrame, by: list[str], seed: int) -> DataFrame:
    """(doc_id, mate): another document of the group (of all, if `by` is empty) for each, the next one in a random order."""
    return ring(docs.select("doc_id", *by), by, [draw(F.col("doc_id"), seed), F.col("doc_id")], "doc_id", "mate").where("doc_id <> mate")


def levels(docs: DataFrame, parts: int = 3, seed: int = 1, tables: Mapping[str, Sequence[tuple[str, str]]] = TABLES) -> DataFrame:
    """(doc_id, level, ctx, ok, bad) from documents (doc_id, source, text): the words of a text in `parts`; the second follows the first.

    The false continuation is that of any document (L0), of one of the same source (L1), a later part of the same text (L2),
    or the true one with one mutation (L3, where one applies).
    """
    # The explode of one element keeps the filter behind it, so that no text is split twice.
    words = docs.select("doc_id", "source", F.explode(F.array(word_list(F.col("text")))).alias("w")).where(F.size("w") >= 4 * parts)
    n = F.floor(F.size("w") / parts).cast("int")
    cut = words.select("doc_id", "source", *[F.slice("w", (n * i + 1).cast("int"), n).alias(name) for i, name in enumerate(("ctx", "ok", "later"))])
    base, other = cut.select("doc_id", "ctx", "ok", "later"), cut.select(F.col("doc_id").alias("mate"), F.col("ok").alias("bad"))
    # What a text gives by itself comes from one reading of it, both kinds of mates share the two joins with words.
    own = base.select("doc_id", "ctx", "ok", "later", F.explode(F.array(mutated_words(F.col("ok"), tables))).alias("m"))
    made = F.array(F.struct(F.lit("L2").alias("level"), F.col("later").alias("bad")), F.struct(F.lit("L3").alias("level"), with_mutation(F.col("ok"), F.col("m")).alias("bad")))
    out = own.select("doc_id", "ctx", "ok", F.explode(made).alias("x")).select("doc_id", "x.level", "ctx", "ok", "x.bad").where("bad is not null")
    ids = checkpointed(cut.select("doc_id", "source"))
    found = [mates(ids, by, seed).withColumn("level", F.lit(level)) for level, by in (("L0", []), ("L1", ["source"]))]
    pairs = reduce(DataFrame.unionByName, found).join(other, "mate").select("doc_id", "level", "bad")
    out = out.unionByName(pairs.join(base.drop("later"), "doc_id").select("doc_id", "level", "ctx", "ok", "bad"))
    return out


def overlap(pairs: DataFrame) -> DataFrame:
    """(level, pairs, to_ok, to_bad, margin): mean Jaccard overlap of the context with both continuations."""
    # Overlaps are columns of their own, so that each is made once a row and not once for each mean.
    rows = pairs.select("level", jaccard(F.col("ctx"), F.col("ok")).alias("ok"), jaccard(F.col("ctx"), F.col("bad")).alias("bad"))
    ok, bad = F.col("ok"), F.col("bad")
    return rows.groupBy("level").agg(F.count("*").alias("pairs"), F.round(F.avg(ok), 6).alias("to_ok"), F.round(F.avg(bad), 6).alias("to_bad"), F.round(F.avg(ok - bad), 6).alias("margin"))

"""Prompts, responses and sections of serialised texts as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import last_index, strip, word_list


def split_at_last(text: Column, mark: str, keep: str) -> Column:
    """struct(prompt, response) at the last place of `mark`, which stays with the "prompt" or the "response"; nulls if there is none."""
    at = last_index(text, mark) + 1 + (len(mark) if keep == "prompt" else 0)
    there = F.contains(text, F.lit(mark))
    prompt, response = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
    return F.struct(F.when(there, F.regexp_replace(prompt, "\\s+$", "")).alias("prompt"), F.when(there, strip(response)).alias("response"))


def explanation(text: Column, limit: int = 600) -> Column:
    """The first `limit` characters up to their last full stop that a space follows, or all of them if there is none."""
    cut = F.substring(text, 1, limit)
    at = last_index(cut, ". ")
    return F.when(at >= 0, F.substring(cut, F.lit(1), at + 1)).otherwise(cut)


def explained(answer: Column, text: Column, near: int = 120) -> Column:
    """The answer with its explanation behind it, unless the explanation says the answer in its first `near` characters."""
    more = explanation(text)
    return F.when(F.contains(F.lower(F.substring(more, 1, near)), F.lower(answer)), more).otherwise(F.concat(answer, F.lit(". "), more))


def sections(text: Column, names: Sequence[str]) -> Column:
    """A struct with what stands behind each [NAME], case aside, up to the next of the names; null where it is missing."""
    any_ = "|".join(names)
    return F.struct(*[F.nullif(strip(F.regexp_extract(text, f"(?is)\\[{n}\\](.*?)(?=\\[(?:{any_})\\]|$)", 1)), F.lit("")).alias(n.lower()) for n in names])


def tail_and_head(context: Column, candidate: Column, tail: int, head: int) -> tuple[Column, Column]:
    """The last words of a context and the first words of a candidate."""
    words = word_list(context)
    return F.slice(words, F.greatest(F.size(words) - tail + 1, F.lit(1)), F.lit(tail)), F.slice(word_list(candidate), 1, head)


def word_language(text: Column, spanish: Sequence[str], english: Sequence[str], marks: str = "¿¡ñ") -> Column:
    """es if more words are Spanish than English, a mark counting for two words, else en."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúüñ]+"), F.lit(0))
    count = lambda some: F.size(F.filter(words, lambda w: w.isin(*some)))
    return F.when(count(spanish) + 2 * F.regexp_count(text, F.lit(f"[{marks}]")) > count(english), "es").otherwise("en")

"""A fine taxonomy: counts of many lexicons in one pass, and the rule that weighs them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4)
def _automaton(lexicons: tuple[tuple[str, ...], ...]):
    import ahocorasick

    owners: dict[str, list[int]] = {}
    for i, stems in enumerate(lexicons):
        for stem in dict.fromkeys(stems):
            owners.setdefault(stem, []).append(i)
    tool = ahocorasick.Automaton()
    for n, (stem, own) in enumerate(owners.items()):
        tool.add_word(stem, (n, own))
    tool.make_automaton()
    return tool


def lexicon_hits(text: Column, lexicons: Sequence[Sequence[str]]) -> Column:
    """How many different stems of each lexicon (in lower case) the text has, as an array of integers.

    One automaton over all stems reads a text once, however many lexicons there are.  A null text hits nothing.
    """
    key = tuple(map(tuple, lexicons))

    @F.pandas_udf("array<int>")
    def hits(texts: pd.Series) -> pd.Series:
        tool, out = _automaton(key), []
        for t in texts:
            counts = np.zeros(len(key), np.int32)
            for own in dict((found[0], found[1]) for _, found in tool.iter(t or "")).values():
                counts[own] += 1
            out.append(counts)
        return pd.Series(out)

    return hits(F.lower(text))


def best_of(hits: Column, names: Sequence[str], first: int) -> tuple[Column, Column]:
    """The first label with most hits among those that start at `first`, and its hits."""
    own = F.slice(hits, first + 1, len(names))
    most = F.array_max(own)
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(own, most).cast("int")), most


def fine_label(hits: Column, leading: Sequence[str], other: Sequence[str]) -> Column:
    """The label that the hits give: those of `leading`, then of `other`, then of the marks come in this order.

    A leading label needs two hits, and not fewer than the best other label or fewer than three marks; else the other
    label counts if it has a hit, then the leading one, and "other" if nothing has.
    """
    lead, leads = best_of(hits, leading, 0)
    rest, rests = best_of(hits, other, len(leading))
    marks = F.element_at(hits, -1)
    return F.when((leads >= 2) & ((leads >= rests) | (marks < 3)), lead).when(rests >= 1, rest).when(leads >= 1, lead).otherwise("other")


def cascade(labelled: Mapping[str, Column], given: Mapping[str, Column], coarse: Column) -> tuple[Column, Column]:
    """(label, where it comes from): the first source whose text is there and not empty decides, else the coarse label.

    `labelled` has the label of each source's text, `given` the text itself, both in order.
    """
    label, source = None, None
    for name in labelled:
        there = F.coalesce(given[name], F.lit("")) != ""
        label = (F if label is None else label).when(there, labelled[name])
        source = (F if source is None else source).when(there, name)
    return label.otherwise(coarse), source.otherwise("coarse")


def lexicon_lists(leading: Mapping[str, Sequence[str]], other: Mapping[str, Sequence[str]], marks: Sequence[str]) -> list[Sequence[str]]:
    """Lexicons in the order that `fine_label` reads."""
    return [*leading.values(), *other.values(), marks]

"""Position logic on texts and sequences: differences, spans, chunks and scores.  Small functions, and Arrow UDFs over them."""

from __future__ import annotations

import ast
import re
import unicodedata
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What tells R code, fixed values.
R_MARKS = ("<-", "library(", "function(", "data.frame(", "ggplot(", "%>%", "lm(", "c(")

#: Connectives and relation verbs of the token role score, fixed values.
CONNECTIVES = ("because", "therefore", "however", "although", "thus", "hence", "whereas", "but", "if", "then", "so")
RELATIONS = ("causes", "affects", "increases", "decreases", "reduces", "promotes", "inhibits", "predicts", "drives")


def udf(f: Callable, kind: str):
    """An Arrow UDF that applies a function of one value; null gives null."""

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else f(v))

    return run


def affix_difference(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """(start, end in a, end in b) of what lies between the common prefix and the common suffix."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    return start, len(a) - end, len(b) - end


def changes(a: Sequence, b: Sequence) -> list[tuple[str, list, list]]:
    """(operation, taken from a, put from b) of an alignment."""
    return [(op, list(a[i:j]), list(b[k:m])) for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal"]


def literal_span(answer: str, passage: str, least_words: int = 3) -> str | None:
    """The answer if the passage has it, else its longest run of `least_words` words or more that the passage has."""
    if answer and answer in passage:
        return answer
    words = answer.split()
    # What is inside a run that the passage has, it has too: the end of the longest run from a word never lies before that of the word before.
    best, end = (0, 0), 0
    for start in range(len(words)):
        end = max(end, start)
        while end < min(len(words), start + len(words) - 1) and " ".join(words[start : end + 1]) in passage:
            end += 1
        best = max(best, (end - start, -start))
    n, start = best[0], -best[1]
    return " ".join(words[start : start + n]) if n >= least_words else None


def is_code(text: str) -> bool:
    """Python that parses, or text with a mark of R."""
    try:
        return bool(ast.parse(text).body)
    except (SyntaxError, ValueError):
        return any(m in text for m in R_MARKS)


def title_form(title: str) -> str:
    """Decomposed to ASCII, lower case, other marks as single spaces."""
    plain = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()
    return " ".join(re.sub(r"[^a-z0-9]+", " ", plain).split())


_HEADING = re.compile(r"^\s*#{0,4}\s*(?:abstract|summary|introduction|background|main|results)\b", re.I)


def front_matter(text: str) -> str:
    """From the first content heading within 40 lines of a journal notice, else from the first of the first 200 lines."""
    lines = text.split("\n")
    notice = next((i for i, x in enumerate(lines[:200]) if "journal information" in x.lower()), None)
    where = range(notice + 1, min(len(lines), notice + 41)) if notice is not None else range(min(len(lines), 200))
    start = next((i for i in where if _HEADING.match(lines[i])), None)
    if start is None and notice is not None:
        start = next((i for i in range(min(len(lines), 200)) if _HEADING.match(lines[i])), None)
    return "\n".join(lines[start:]) if start is not None else text


def markdown_body(text: str, junk: str = r"^\s*(?:\d{1,4}|[ivxlc]{1,6}|\.{4,}.*|!\[.*)\s*$", tail: str = r"^#{1,3}\s*(?:references|bibliography|appendix|acknowledg)", least: int = 120) -> str:
    """Without junk lines, from the first heading that prose follows, up to a closing heading beyond two fifths of the text."""
    lines = [x for x in text.split("\n") if not re.match(junk, x, re.I)]
    heads = [i for i, x in enumerate(lines) if x.startswith("#")]
    prose = {i: sum(map(len, lines[i + 1 : j])) for i, j in zip(heads, [*heads[1:], len(lines)], strict=True)}
    start = next((i for i in heads if prose[i] >= least), 0)
    lines = lines[start:]
    total, seen = sum(map(len, lines)), 0
    for i, x in enumerate(lines):
        if seen > 0.4 * total and re.match(tail, x, re.I):
            return "\n".join(lines[:i]).strip()
        seen += len(x)
    return "\n".join(lines).strip()


def chunks(text: str, size: int, back: float = 0.5) -> list[str]:
    """Parts of `size` characters at most that end at a line break where one lies beyond `back` of the part."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text) and (cut := text.rfind("\n", at + int(size * back), end)) > at:
            end = cut + 1
        out.append(text[at:end].strip())
        at = end
    return [x for x in out if x]


def number_before_noun(text: str, nouns: Sequence[str], reach: int = 60) -> bool:
    """Whether a number is followed by a countable noun within so many characters."""
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, nouns)) + r")s?\b", re.I)
    return any(pattern.search(text[m.end() : m.end() + reach]) for m in re.finditer(r"\d+(?:\.\d+)?", text))


def arguments_match(given: str, wanted: str, least: float = 0.8) -> bool:
    """Equal, contained, or alike, accents and case aside."""
    a, b = (title_form(x) for x in (given, wanted))
    return bool(a and b) and (a == b or a in b or b in a or SequenceMatcher(None, a, b).ratio() >= least)


def find_run(ids: Sequence[int], run: Sequence[int], start: int = 0) -> int:
    """Where a run of ids begins, or -1."""
    return next((i for i in range(start, len(ids) - len(run) + 1) if list(ids[i : i + len(run)]) == list(run)), -1) if run else -1


def response_spans(turns: Sequence[tuple[Sequence[int], bool]], end: int, limit: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Ids of turns laid end to end with `end` at the close, and [start, stop) of the responses.

    Cut to `limit`; the last response holds the end token; without any response token left, all is empty.
    """
    ids: list[int] = []
    spans: list[tuple[int, int]] = []
    for tokens, response in turns:
        start = len(ids)
        ids += tokens
        if response and tokens:
            spans.append((start, len(ids)))
    ids.append(end)
    if spans and spans[-1][1] == len(ids) - 1:
        spans[-1] = (spans[-1][0], len(ids))
    spans = [(a, min(b, limit)) for a, b in spans if a < limit]
    return (list(ids[:limit]), spans) if spans else ([], [])


def role_scores(words: Column, entities: tuple[str, ...] = ()) -> Column:
    """For each word 1.0, and more for connectives (3), relation verbs (2.5), entities and numbers (2), capitalised words (0.5; not for all capitals)."""
    low = lambda w: F.lower(w)
    more = lambda when, n: F.when(when, n).otherwise(0.0)
    return F.transform(
        words,
        lambda w: F.lit(1.0) + more(low(w).isin(*CONNECTIVES), 3.0) + more(low(w).isin(*RELATIONS), 2.5) + more(low(w).isin(*entities) if entities else F.lit(False), 2.0)
        + more(w.rlike("^[+-]?(?:\\d+(?:[.,]\\d+)?|\\d*\\.\\d+)(?:\\s*%)?$"), 2.0) + more(w.rlike("^\\p{Lu}.") & (w != F.upper(w)), 0.5),
    )


def inferable(ok: str, bad: str, context: str) -> str:
    """Why the false text of a pair can be told from the context: same, negation, number, context word, or provenance (it can't)."""
    a, b = ok.split(), bad.split()
    if a == b:
        return "same"
    s, i, j = affix_difference(a, b)
    x, y = " ".join(a[s:i]), " ".join(b[s:j])
    if "not" in {*a[s:i], *b[s:j]}:
        return "negation"
    if re.search(r"\d", x + y):
        return "number" if any(n in context for n in re.findall(r"\d[\d.,]*", x)) else "provenance"
    return "context word" if x and x.lower() in context.lower() else "provenance"

"""Whole arrays and objects in noisy text, and values behind markers, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the scanner tells apart: an escaped character, a quote, a bracket, or a run of anything else.
TOKEN = '(?s)\\\\.|["\\[\\]{}]|[^\\\\"\\[\\]{}]+|\\\\'
STATE = "struct<at:int,open:string,quoted:boolean,start:int,spans:array<struct<start:int,size:int>>>"


def top_blocks(text: Column) -> Column:
    """The outermost [...] and {...} of a text, in order, as an array of strings.

    Brackets inside double quotes do not count within a block, and quotes outside one are plain text.  A closing bracket of
    the wrong kind spoils the block that is open: the scan goes on behind it as outside.  A block that never closes is
    none.  The fold goes over runs between brackets and quotes, not over characters.
    """

    def step(s: Column, token: Column) -> Column:
        end = s["at"] + F.length(token)
        inside = s["open"] != ""
        quoted = F.when(inside & (token == '"'), ~s["quoted"]).otherwise(s["quoted"])
        opens = token.isin("[", "{") & ~s["quoted"]
        closes = token.isin("]", "}") & ~s["quoted"] & inside
        fits = F.right(s["open"], F.lit(1)) == F.when(token == "]", "[").otherwise("{")
        stack = F.when(opens, F.concat(s["open"], token)).when(closes & fits, F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)).when(closes, "").otherwise(s["open"])
        done = closes & fits & (F.length(s["open"]) == 1)
        spans = F.when(done, F.array_append(s["spans"], F.struct(s["start"].alias("start"), (end - s["start"]).alias("size")))).otherwise(s["spans"])
        return F.struct(end.alias("at"), stack.alias("open"), quoted.alias("quoted"), F.when(opens & ~inside, s["at"]).otherwise(s["start"]).alias("start"), spans.alias("spans")).cast(STATE)

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(0).alias("start"), F.array().cast("array<struct<start:int,size:int>>").alias("spans")).cast(STATE)
    spans = F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), begin, step, lambda s: s["spans"])
    return F.transform(spans, lambda p: F.substring(text, p["start"] + 1, p["size"]))


def marked_values(text: Column, marks: Mapping[str, str]) -> Column:
    """A struct with the value behind the first mark of each name that has one, or null.

    Marks are patterns without groups.  A value is the rest of the mark's line, or if that is blank the block of lines
    below it, up to a blank line or the next mark.
    """
    open_, close = "\u0001", "\u0002"
    clean = F.translate(F.coalesce(text, F.lit("")), open_ + close, "  ")
    for name, pattern in marks.items():
        clean = F.regexp_replace(clean, pattern, f"{open_}{name}{close}")
    pieces = F.split(clean, open_)
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def value(piece: Column) -> Column:
        rest = F.substring_index(piece, close, -1)
        line = F.regexp_extract(rest, "^([^\\n]*)", 1)
        block = F.regexp_extract(F.regexp_replace(rest, "^\\s+", ""), "(?s)^(.*?)(?:\\n[ \\t]*\\n|$)", 1)
        return F.regexp_replace(F.when(F.trim(line) != "", line).otherwise(block), "^\\s+|\\s+$", "")

    found = F.transform(pieces, lambda p: F.struct(F.substring_index(p, close, 1).alias("name"), value(p).alias("value")))
    good = F.filter(found, lambda f: f["value"] != "")

    def first(name: str) -> Column:
        return F.get(F.filter(good, lambda g: g["name"] == name), 0)["value"].alias(name)

    return F.struct(*map(first, marks))

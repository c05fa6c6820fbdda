"""Argument skeletons of texts as Column expressions: five optional stages, found by labels, headings and phrases.

A text is marked at labels or heading lines and split at its marks; what follows a mark is
the body of the mark's stage.  Stages are an array of five strings in the order of `ORDER`, null where missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

ORDER = ("OBS", "HYP", "PRED", "EVID", "CONC")

# Labels of structured abstracts, and the stages that some of them open.
LABEL = r"(?i)(Background|Introduction|Background\s*/?\s*Objectives?|Objective[s]?|Aim[s]?|Design|Setting|Participants|Methods?|Methodology|Measurements?|Results?|Findings?|Main findings?|Outcomes?|Conclusions?|Discussion|Interpretation)\s*[:.]\s*"
LABELLED = {
    "OBS": ("background", "background/objectives", "introduction", "objective", "objectives", "aim", "aims", "setting", "participants"),
    "EVID": ("results", "findings", "main findings", "outcomes"),
    "CONC": ("conclusions", "conclusion", "discussion", "interpretation"),
}

#: As `LABEL`, looked for only where three letters can begin one.
LABEL_JAVA = LABEL.replace("(?i)", "(?i)(?=[biodspmrfca][aneiuob][ctjmsrani])", 1)

# Heading lines, and the beginnings of those that open a stage.
HEADING = r"(?i)^(?:introduction|background|introducit|[oó]n|methods?|material(?:s)? and methods?|methodology|experimental (?:section|methods?|procedure|setup)|results?|findings?|results and discussion|discussion|conclusions?|discussion and conclusions?|implications?|summary|synthesis|[0-9]+\.?\s*(?:introduction|background|methods?|results?|discussion|conclusion))$"
HEADED = {"OBS": ("intro", "backg"), "EVID": ("result", "finding"), "CONC": ("discussion", "conclu", "summary", "implic")}

# Phrases that announce a stage, in lower-cased sentences.
PHRASES = {
    "OBS": r"(?:we (?:report|present|investigate|examine|study|analy[sz]e)|this (?:study|paper|work|article)|the aim|objective of|to better understand)",
    "HYP": r"(?:we (?:hypothesi[sz]e|hypothesi[sz]ed|expect(?:ed)?|tested? whether)|our (?:hypothesis|prediction)|the hypothesis|a hypothesis|could (?:explain|affect|drive|determine))",
    "EVID": r"(?:we (?:found|observed|show[ed]?|demonstrate[ed]?|report(?:ed)? that)|our (?:results|findings|data|analys[ei]s) (?:show|suggest|indicate|demonstrate|reveal|support)|results (?:of|from|show|indicate)|statistically significant|significant(?:ly)? (?:effect|difference|association))",
    "CONC": r"(?:we conclude|in conclusion|these (?:results|findings|data) (?:suggest|indicate|support|demonstrate)|taken together|overall,? (?:our|these)|implications? (?:of|for)|suggest(?:ing|s)? that)",
}

#: Marks that no text holds: before a label, and between it and its body.
OPEN, CLOSE = "\u0001", "\u0002"

#: What every text with a heading line has: the beginning of one behind a line break.
HEADING_START = HEADING.replace("(?i)^", f"(?i)(?:^|\\n)[\\s{OPEN}{CLOSE}]*").removesuffix("$")


def _first_bodies(found: Column) -> Column:
    """The first body of each stage in an array of (stage, body)."""

    def first(stage: str) -> Column:
        return F.get(F.filter(found, lambda g: g["stage"] == stage), 0)["body"]

    return F.array(*map(first, ORDER))


def _pieces(marked: Column) -> Column:
    """What stands behind each mark, as (mark, body, place, last)."""
    pieces = F.split(marked, OPEN)
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(pieces, lambda p: F.struct(F.substring_index(p, CLOSE, 1).alias("mark"), F.substring_index(p, CLOSE, -1).alias("body")))


def _unmarked(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, "  ")).otherwise(text)


def labelled(text: Column, least: int = 20, most: int = 900, flat: Column | None = None) -> Column:
    """Stages from inline labels, two at least: of each the first body of `least` characters (the last label's may be shorter), cut at `most`.

    A label is one wherever it stands, if a colon or stop follows; methods and unknown labels only end the body before."""
    flat = T.normal_space(F.coalesce(text, F.lit(""))) if flat is None else flat
    flat = F.when(flat.contains(OPEN) | flat.contains(CLOSE), T.normal_space(_unmarked(flat))).otherwise(flat)
    marked = F.regexp_replace(flat, LABEL_JAVA, f"{OPEN}$1{CLOSE}")

    def stage(mark: Column) -> Column:
        return reduce(lambda c, s: c.when(F.lower(mark).isin(*LABELLED[s]), s), list(LABELLED)[1:], F.when(F.lower(mark).isin(*LABELLED["OBS"]), "OBS"))

    def bodies(pieces: Column) -> Column:
        found = F.transform(pieces, lambda p, i: F.struct(stage(p["mark"]).alias("stage"), F.substring(F.regexp_replace(p["body"], "^[ :]+|[ :]+$", ""), 1, most).alias("body"), (i + 1 == F.size(pieces)).alias("last")))
        good = F.filter(found, lambda f: (F.length(f["body"]) >= least) | f["last"])
        return _first_bodies(good)

    # A lambda over an array of one holds the pieces, which are used several times.
    found = F.get(F.transform(F.filter(F.array(_pieces(marked)), lambda ps: F.size(ps) >= 2), bodies), 0)
    return F.coalesce(found, F.array(*[F.lit(None).cast("string")] * len(ORDER)))


def headed(text: Column, least: int = 121, most: int = 1500) -> Column:
    """Stages from heading lines: of each the first body of `least` characters, its lines joined by spaces and cut at `most`."""
    lines = F.transform(F.split(_unmarked(text), "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))

    def stage(line: Column) -> Column:
        starts = {s: reduce(lambda c, b: c | line.startswith(b), beginnings, F.lit(False)) for s, beginnings in HEADED.items()}
        return reduce(lambda c, s: c.when(starts[s], s), list(starts)[1:], F.when(starts["OBS"], "OBS")).otherwise("")

    marked = F.transform(lines, lambda x: F.when((F.length(x) < 90) & x.rlike(HEADING), F.concat(F.lit(OPEN), stage(F.lower(x)), F.lit(CLOSE))).otherwise(x))
    found = F.transform(_pieces(F.array_join(F.filter(marked, lambda x: x != ""), " ")), lambda p: F.struct(p["mark"].alias("stage"), F.substring(F.trim(p["body"]), 1, most).alias("body")))
    good = F.get(F.transform(F.array(found), lambda fs: _first_bodies(F.filter(fs, lambda f: F.length(f["body"]) >= least))), 0)
    return F.when(text.rlike(HEADING_START), good).otherwise(F.array(*[F.lit(None).cast("string")] * len(ORDER)))


def sentences(text: Column, limit: int | None = None) -> Column:
    """Sentences of a text (of its first `limit` characters): cut after . ! or ? before a capital, digit, brace or backslash."""
    flat = T.normal_space(text)
    return _cut(flat if limit is None else F.substring(flat, 1, limit))


def _cut(flat: Column) -> Column:
    """Sentences of a text whose white space is single spaces."""
    return F.filter(F.split(flat, " (?<=[.!?] )(?=[A-Z0-9{\\\\\\[])"), lambda s: s != "")


def announced(parts: Column, least: int = 46, most: int = 400, flat: Column | None = None) -> Column:
    """Stages from the first sentence of `least` characters with a phrase, cut at `most`.

    Observations and hypotheses are looked for in the first third of the sentences and the one behind it, evidence and
    conclusions from the end of the first third on.  With `flat`, the text of the sentences, these are only looked at if it has the phrase at all."""
    third = F.greatest(F.lit(1), F.floor(F.size(parts) / 3))

    def first(stage: str) -> Column:
        if stage not in PHRASES:
            return F.lit(None).cast("string")
        late = stage in ("EVID", "CONC")
        hit = F.filter(parts, lambda s, i: ((i >= third) if late else (i <= third)) & (F.length(s) >= least) & F.lower(s).rlike(PHRASES[stage]))
        found = F.substring(F.get(hit, 0), 1, most)
        return found if flat is None else F.when(F.lower(flat).rlike(PHRASES[stage]), found)

    return F.array(*[first(s) for s in ORDER])


def skeletons(docs: DataFrame, text_col: str = "text", least: int = 3) -> DataFrame:
    """Add strategy, stages (how many) and skeleton ([STAGE] body lines, or null), from the whole text.

    Stages come from labels; if these are fewer than `least`, headings replace and add stages, and if there still are
    fewer, phrases add what is missing.  The strategy is "headings" if two stages or more came from them, else "labels" if any did,
    else "phrases" if any did, else "none".  A missing observation is the first sentence over 40 characters of the first
    four, cut at 200.  LaTeX should be stripped before.
    """
    text = F.col(text_col)
    rows = docs.withColumn("__flat", T.normal_space(F.coalesce(text, F.lit(""))))
    rows = rows.withColumn("__parts", _cut(F.col("__flat")))
    rows = rows.withColumns({"__labels": labelled(text, flat=F.col("__flat")), "__headings": headed(text), "__phrases": announced(F.col("__parts"), flat=F.col("__flat"))})

    def count(c: str) -> Column:
        return F.size(F.array_compact(F.col(c)))

    rows = rows.withColumn("__two", F.when(count("__labels") < least, F.zip_with("__headings", "__labels", lambda h, s: F.coalesce(h, s))).otherwise(F.col("__labels")))
    rows = rows.withColumn("__three", F.when(count("__two") < least, F.zip_with("__two", "__phrases", lambda s, p: F.coalesce(s, p))).otherwise(F.col("__two")))
    strategy = F.when((count("__labels") < least) & (count("__headings") >= 2), "headings").when(count("__labels") > 0, "labels")
    strategy = strategy.when((count("__two") < least) & (count("__phrases") > 0), "phrases").otherwise("none")
    opening = F.substring(F.get(F.filter(F.slice("__parts", 1, 4), lambda s: F.length(s) > 40), 0), 1, 200)
    rows = rows.withColumn("__stages", F.transform("__three", lambda s, i: F.when(i == 0, F.coalesce(s, opening)).otherwise(s)))
    lines = F.zip_with(F.array(*[F.lit(s) for s in ORDER]), "__stages", lambda n, s: F.when(s != "", F.concat(F.lit("["), n, F.lit("] "), F.trim(s))))
    return rows.select(*docs.columns, strategy.alias("strategy"), count("__stages").alias("stages"), F.nullif(F.array_join(F.array_compact(lines), "\n"), F.lit("")).alias("skeleton"))

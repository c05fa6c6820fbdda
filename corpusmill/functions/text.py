"""Text normalisation as Column expressions: cleaning, cutting, keys and counts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: LaTeX environments and commands, fixed values.
ENVIRONMENTS = ("figure", "table", "algorithm", "lstlisting", "verbatim", "tikzpicture", "align", "equation", "eqnarray", "gather", "multline", "itemize")
REFERENCES = ("cite", "citep", "citet", "ref", "label", "eqref")
WRAPPERS = ("bf", "textbf", "textit", "emph", "texttt", "section", "subsection", "subsubsection", "paragraph", "title", "author", "affiliation", "email", "url", "href")

#: Question and answer words that carry no content, fixed values.
STOP_WORDS = """a an the of in on at to for and or but is are was were be been it its this that these those with by from as we i you they he she not no do
does did have has had can could will would should may might than then so such""".split()

#: Substrings that vote for a language, fixed values.
SPANISH, ENGLISH = (" el ", " la ", " de ", " que ", " los "), (" the ", " of ", " and ", " in ", " a ")

#: Ids that mean there is none, fixed values.
NO_ID = ("none", "null", "0", "")

#: Where an ASCII word begins and ends. Java's \\b also counts letters beyond ASCII as parts of words, RE2's does not.
WORD_START, WORD_END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"

ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")


def sub(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def strip(text: Column) -> Column:
    """Without white space at either end, line breaks included."""
    return sub(text, ("^\\s+", ""), ("\\s+$", ""))


def title_abstract(title: Column, abstract: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(abstract, F.lit(""))))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def safe_year(value: Column, default: int = 1900) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(default))


def clean_whitespace(text: Column) -> Column:
    """Runs of blanks become one, three or more line breaks two; blanks before a break and at the ends go."""
    return strip(sub(text, ("[ \\t]+", " "), ("\\n{3,}", "\n\n"), (" +\\n", "\n")))


def last_index(text: Column, mark: str) -> Column:
    """Zero-based place of the last `mark`, or -1."""
    back = F.locate(mark[::-1], F.reverse(text))
    return F.when(back > 0, F.length(text) - back - len(mark) + 1).otherwise(F.lit(-1))


def truncate_at_newline(text: Column, limit: int, share: float = 0.8) -> Column:
    """At most `limit` characters; back to the last line break if that lies beyond `share` of them."""
    cut = F.substring(text, 1, limit)
    at = last_index(cut, "\n")
    return F.when(F.length(text) <= limit, text).when(at > limit * share, F.substring(cut, F.lit(1), at)).otherwise(cut)


def truncate_at_space(text: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    cut = F.substring(flat, 1, limit)
    at = last_index(cut, " ")
    return F.when(F.length(flat) <= limit, flat).when(at > 0, F.substring(cut, F.lit(1), at)).otherwise(cut)


def _any(*patterns: str) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


#: What is braced after a command, and a comment up to the end of its line.
BRACED, COMMENT = "\\{([^{}]*)\\}", "(?<!\\\\)%[^\\n]*"


def strip_latex(text: Column) -> Column:
    """Prose of a LaTeX source: comments, whole environments, references and mathematics go, wrapped text stays.

    One expression names all that goes (an environment up to the end of its own name), one all wrappers."""
    environment = f"\\\\begin\\{{({_any(*ENVIRONMENTS)})\\}}[\\s\\S]*?\\\\end\\{{\\1\\}}"
    gone = _any(environment, f"\\\\(?:{_any(*REFERENCES)}){BRACED}", "\\$[^$]*\\$", "\\\\\\[[\\s\\S]*?\\\\\\]")
    wrapped = f"\\\\(?:{_any(*WRAPPERS)})\\*?{BRACED}"
    bare = "\\\\(?:item|itemsep|vspace|hspace)\\b|\\\\[a-zA-Z]+\\*|~|\\\\ "
    text = sub(F.regexp_replace(text, COMMENT, ""), (gone, " "), (wrapped, "$1"), (bare, " "), ("\\\\([&%])", "$1"))
    return strip(sub(text, ("[ \\t]+", " "), ("\\n\\s*\\n+", "\n")))


def latex_body(text: Column) -> Column:
    """The document after its preamble: commands go with their arguments, the content of mathematics and line breaks stay."""
    body = F.substring_index(F.regexp_replace(text, COMMENT, " "), "\\begin{document}", -1)
    link = "\\\\?\\b(?:url|href|cite|ref|label|eqref)\\b[^{}]*\\{[^{}]*\\}?"
    command = "\\\\[a-zA-Z]+\\*?(?:\\[[^\\]]*\\])?(?:\\{[^{}]*\\})?"
    return sub(F.replace(body, F.lit("$"), F.lit("")), (_any(link, command, "~"), " "), ("\\\\([&%])", "$1"), ("[ \\t]+", " "))


def strip_html(text: Column) -> Column:
    text = F.regexp_replace(text, "<[^>]+>", "")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def question_key(text: Column) -> Column:
    return normal_space(F.lower(text))


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), *ACCENTS)


def number_form(text: Column, legacy: bool = False) -> Column:
    """Thousands commas and zeros after a decimal point dropped; `legacy` drops zeros of integers too."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    if legacy:
        return F.regexp_replace(plain, "[0.]+$", "")
    return sub(plain, ("(\\.\\d*?)0+$", "$1"), ("\\.$", ""))


def slug(title: Column, limit: int = 70) -> Column:
    return F.substring(sub(fold_accents(title), ("[^a-z0-9]+", "-"), ("^-+|-+$", "")), 1, limit)


def split_list(text: Column, mark: str = ";") -> Column:
    return F.filter(F.transform(F.split(text, mark), F.trim), lambda x: x != "")


def decomposed(text: Column) -> Column:
    """Compatibility decomposition (NFKD), which has no built-in function."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")

    return run(text)


#: Runs of characters beyond ASCII. What is ASCII decomposes to itself, and no mark moves across it.
BEYOND_ASCII = "[^\\x00-\\x7F]+"


def decomposed_runs(text: Column) -> Column:
    """As `decomposed`; only the runs beyond ASCII of a text go to Python, not the text."""
    some = F.when(text.rlike(BEYOND_ASCII), text)
    runs = F.array_join(F.regexp_extract_all(some, F.lit(BEYOND_ASCII), F.lit(0)), "\n")
    new = F.split(decomposed(runs), "\n", -1)
    joined = F.array_join(F.zip_with(F.split(some, BEYOND_ASCII, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.coalesce(joined, text)


def content_hash(text: Column, limit: int | None = None) -> Column:
    """First 20 hex digits of the SHA-1 of the decomposed text (or its first `limit` characters), lower-cased, white space collapsed.

    ASCII decomposes to itself, and its hash comes from built-in functions alone: only runs of other characters go to Python."""
    plain = normal_space(F.lower(decomposed_runs(text)))
    return F.substring(F.sha1(plain if limit is None else F.substring(plain, 1, limit)), 1, 20)


def present(value: Column) -> Column:
    """The trimmed id, or null if it means that there is none."""
    value = F.trim(value)
    return F.when(~F.lower(value).isin(*NO_ID), value)


def canonical_key(pmcid: Column, pmid: Column, arxiv: Column, doi: Column, text: Column) -> Column:
    ids = [F.concat(F.lit(f"{kind}:"), present(value)) for kind, value in (("pmc", pmcid), ("pmid", pmid), ("arxiv", arxiv), ("doi", doi))]
    known = F.coalesce(*ids)
    # Texts of rows with an id are not looked at, by Python neither.
    return F.coalesce(known, F.concat(F.lit("h:"), content_hash(F.when(known.isNull(), F.coalesce(text, F.lit(""))))))


def dedup_key(pmcid: Column, pmid: Column) -> Column:
    return F.upper(F.trim(F.coalesce(F.nullif(pmcid, F.lit("")), pmid)))


def year_of(date: Column, fallback: Column) -> Column:
    found = F.regexp_extract(date, "((?:19|20)\\d{2})", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.substring(fallback, 1, 4)).try_cast("int")


def human_size(n: Column) -> Column:
    out = None
    for unit, scale in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        shown = F.format_string(f"%.1f {unit}", n / scale)
        out = (F if out is None else out).when(n >= scale, shown)
    return out.otherwise(F.format_string("%d B", n))


def occurrences(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)


def language_vote(text: Column, limit: int | None = None) -> Column:
    """es if its marks outnumber the English ones by half, else en; over the whole text or its first `limit` characters."""
    low = F.lower(text if limit is None else F.substring(text, 1, limit))
    es, en = (sum((occurrences(low, w) for w in marks), F.lit(0)) for marks in (SPANISH, ENGLISH))
    return F.when(es > en * 1.5, "es").otherwise("en")


def alpha_share(text: Column, limit: int | None = None) -> Column:
    """Share of letters in the text or its first `limit` characters."""
    part = text if limit is None else F.substring(text, 1, limit)
    return F.regexp_count(part, F.lit("\\p{L}")) / F.greatest(F.length(part), F.lit(1))


def clean_enough(text: Column, least: int = 200, alpha: float = 0.35) -> Column:
    return F.coalesce((F.length(text) >= least) & (alpha_share(text) >= alpha), F.lit(False))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a space, in order."""
    last = F.size(words) - n
    made = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<string>"))


def gram_hashes(words: Column, n: int) -> Column:
    """Runs of n words as structs (a, b) of two 64-bit hashes, in order; no strings are built."""
    last = F.size(words) - n

    def hashes(i: Column) -> Column:
        run = F.slice(words, i, n)
        return F.struct(F.xxhash64(run).alias("a"), F.xxhash64(F.lit(1), run).alias("b"))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), hashes)).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))


def too_repetitive(text: Column, least_words: int = 15, least_share: float = 0.25) -> Column:
    """At least `least_words` words, and fewer different word pairs than `least_share` of all."""
    words = word_list(text)
    pairs = ngrams(words, 2)
    return (F.size(words) >= least_words) & (F.size(F.array_distinct(pairs)) / F.greatest(F.size(pairs), F.lit(1)) < least_share)


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúñü][a-záéíóúñü\\-']*"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))


def numbers(text: Column, legacy: bool = False) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("\\d[\\d.,]*"), F.lit(0)), lambda n: number_form(n, legacy))


def recall(answer: Column, passage: Column) -> Column:
    """Share of the answer's content words found in the passage; 0 if it has none."""
    words, there = content_words(answer), content_words(passage)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: F.array_contains(there, w))) / F.size(words))


def numbers_supported(answer: Column, passage: Column) -> Column:
    return F.size(F.array_except(numbers(answer), numbers(passage))) == 0


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))

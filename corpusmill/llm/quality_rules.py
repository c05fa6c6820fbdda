"""Quality rules: text statistics and a learned decision list, in DataFrame operations only.

Statistics come from one projection over the whole text.  Rules are learned by
sequential covering from labelled rows: a rule grows by the threshold condition
with the best information gain, is cut back to the prefix that does best on rows
it did not grow on, and is kept if it is precise enough there (on five bad rows at least); then the rows it
covers are set aside and the next rule grows.  Every step is one grouped count over
binned statistics; what reaches the driver is one row for each statistic and bin.
The list becomes one ordered CASE WHEN expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, words

#: Words of a repeated window.
REPEAT = 5

#: What rules may look at, from the columns of `text_statistics`; shares of words are null where a text has none.
SHARES = {
    "words": "n_words",
    "word_length": "word_chars / nullif(n_words, 0)",
    "symbols": "n_symbols / nullif(n_words, 0)",
    "repeats": "n_repeat_words / nullif(n_words, 0)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "marks": "n_exclaim / nullif(n_words, 0)",
    "capitals": "n_upper / nullif(n_words, 0)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", whole_row: str | None = None) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_exclaim, n_upper), one row for each row.

    With `whole_row` the input row is passed on as a struct of that name.
    A null text counts as empty.  A window of five words repeats if its 64-bit
    hash is found twice in the text.  Texts are read whole; a text's arrays stay within its row.
    """
    none = F.array().cast("array<bigint>")
    extra = [F.struct(*[F.col(c) for c in docs.columns]).alias(whole_row)] if whole_row else []
    more = [whole_row] if whole_row else []
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"), *extra)
    t = t.withColumn("w", words(F.col("t"))).withColumn("n_words", F.size("w").cast("long"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    t = t.withColumn("lines", lines)
    at = lambda i, k: F.get("w", i + k)
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - REPEAT), lambda i: F.xxhash64(*[at(i, k) for k in range(REPEAT)]))
    t = t.select(
        "id",
        *more,
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
        F.regexp_count("t", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.when(F.size("w") >= REPEAT, hashes).otherwise(none).alias("h"),
    )
    # Only texts with a repeated window are sorted.
    pairs = F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    t = t.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(pairs)).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    same = lambda e, j: F.coalesce(F.get("s", j)["x"] == e["x"], F.lit(False))
    t = t.withColumn("found", F.array_sort(F.transform(F.filter("s", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    covered = F.aggregate("found", start, lambda a, i: F.struct((i + REPEAT).alias("end"), (a["total"] + i + REPEAT - F.greatest(i, a["end"])).alias("total")), lambda a: a["total"])
    return t.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines", "n_exclaim", "n_upper", *more)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass
class DecisionList:
    """Ordered conjunctions of (statistic, is above, threshold); a text is rejected by the first that holds."""

    rules: list[list[tuple[str, bool, float]]] = field(default_factory=list)

    def expression(self) -> Column:
        """'rule 1', 'rule 2', ... for the first rule that holds, or null; a condition on a null share does not hold."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            when = F.lit(True)
            for name, above, threshold in rule:
                value = F.expr(SHARES[name])
                when = when & ((value > threshold) if above else (value <= threshold))
            out = (F if out is None else out).when(F.coalesce(when, F.lit(False)), F.lit(f"rule {k}"))
        return F.lit(None).cast("string") if out is None else out

    def verdict(self) -> Column:
        """True for texts that no rule rejects."""
        return self.expression().isNull()


def learn_rules(labelled: DataFrame, *, bins: int = 48, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.95, least_share: float = 0.002) -> DecisionList:
    """Learn to reject rows with `bad` = 1.  `labelled` has the columns of `text_statistics`, bad (0 or 1) and grow (boolean).

    A rule is accepted if on the rows it did not grow on at least `precision` of
    what it covers is bad, and it covers `least_share` of all bad rows.  Rows
    with a null label are left out; without bad or good rows the list is empty.
    """
    rows = labelled.where("bad is not null and n_words > 0").select(F.col("bad").cast("int").alias("bad"), "grow", *[F.expr(e).cast("double").alias(n) for n, e in SHARES.items()])
    probs = [i / bins for i in range(1, bins)]
    cuts_row = rows.agg(F.sum("bad"), F.count("*"), *[F.array_distinct(F.concat(F.percentile_approx(n, probs, 10000), F.percentile_approx(F.when(F.col("bad") == 1, F.col(n)), probs, 10000))).alias(n) for n in SHARES]).first()
    bad, total = cuts_row[0] or 0, cuts_row[1]
    found = DecisionList()
    if not bad or bad == total:
        return found
    cuts = {n: sorted(c for c in cuts_row[n] or [] if c is not None) for n in SHARES}

    def below(n: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[n]]), lambda c: c < F.col(n))).alias(n)

    place = {n: below(n) for n in SHARES if cuts[n]}
    binned = rows.select("bad", "grow", *place.values()).persist()
    holds = lambda c: (F.col(c[0]) > c[2]) if c[1] else (F.col(c[0]) <= c[2])
    every = lambda cs: [holds(c) for c in cs]

    def meet(frame: DataFrame, conditions: list) -> DataFrame:
        for c in every(conditions):
            frame = frame.where(c)
        return frame

    try:
        left = binned
        while len(found.rules) < max_rules:
            rule: list[tuple[str, bool, int]] = []
            p0 = n0 = None
            while len(rule) < max_conditions:
                cell = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in place])).alias("c")
                counts = meet(left.where("grow"), rule).select("bad", cell).groupBy("c.name", "c.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
                table = {n: [(0, 0)] * (len(cuts[n]) + 1) for n in place}
                for r in counts:
                    table[r["name"]][r["bin"]] = (r["p"], r["n"])
                p0, n0 = (sum(x[i] for x in next(iter(table.values()))) for i in (0, 1))
                if not p0 or not n0:
                    break
                best = None
                for name, cells in table.items():
                    p = n = 0
                    for k, (dp, dn) in enumerate(cells[:-1]):
                        p, n = p + dp, n + dn
                        for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                            if a:
                                gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))
                                if best is None or gain > best[0] + 1e-9:
                                    best = (gain, (name, above, k))
                if best is None or best[0] <= 0:
                    break
                rule.append(best[1])
            if not rule:
                break
            held = meet(left.where("not grow"), rule[:1])
            sums = [f(F.when(F.lit(True) if not rule[1:k] else _all(every(rule[1:k])), x).otherwise(0)) for k in range(1, len(rule) + 1) for f, x in ((F.sum, F.col("bad")), (F.sum, 1 - F.col("bad")))]
            got = [x or 0 for x in held.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
            scores = [((got[2 * i] - got[2 * i + 1]) / max(1, got[2 * i] + got[2 * i + 1]), -i) for i in range(len(rule))]
            keep = -max(scores)[1] + 1
            p, n = got[2 * keep - 2], got[2 * keep - 1]
            if p < max(5, least_share * bad / 3) or p < precision * (p + n):
                break
            rule = rule[:keep]
            found.rules.append([(name, above, float(cuts[name][k])) for name, above, k in rule])
            # cell k holds values in (cut k-1, cut k]
            left = left.where(~_all(every(rule)))
    finally:
        binned.unpersist()
    return found


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def learn_from_labels(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", stats: DataFrame | None = None, **options) -> DecisionList:
    """Rules for the texts that pass the base rules, from labels (0: bad); a repeated id counts with its smallest label."""
    stats = text_statistics(docs, id_col=id_col, text_col=text_col) if stats is None else stats
    known = labels.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("label")).where("label_id is not null and label is not null")
    labelled = stats.where(~base_failed()).join(known, F.col(id_col) == F.col("label_id")).withColumn("bad", F.when(F.col("label") == 0, 1).otherwise(0)).withColumn("grow", F.pmod(F.xxhash64("label_id"), F.lit(3)) != 0)
    return learn_rules(labelled, **options)


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> tuple[DataFrame, DecisionList]:
    """Statistics, `base_failed`, `rule` (first that rejects, or null) and `kept` for each row of `docs`, and the rules.

    `labels` has `id_col` and `label_col` (0: bad); null or repeated ids count once
    with their smallest label.  `kept` is false if the base rules fail, else what
    the list says.  Texts without words fail the base rules.  A table without
    labels gives an empty list, which keeps all that the base rules keep.
    """
    stats = checkpointed(text_statistics(docs, id_col=id_col, text_col=text_col))
    rules = learn_from_labels(docs, labels, id_col=id_col, label_col=label_col, stats=stats, **options)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.expression())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def keep_good(docs: DataFrame, rules: DecisionList, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that neither the base rules nor the list reject, with all their columns."""
    rows = text_statistics(docs, id_col=id_col, text_col=text_col, whole_row="__row")
    # As an exploded array rather than a filter, which Spark would push below the statistics and so compute them many times.
    kept = F.when(~base_failed() & rules.verdict(), F.array("__row"))
    return rows.select(F.explode_outer(kept).alias("__row")).where(F.col("__row").isNotNull()).select("__row.*")

"""Verifiable statements from the facts of tables: arithmetic, contrasts, syllogisms, chains of equal validity, and damaged tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import in_random_order, running_total

#: Operations: wording and result as an expression of a and b.
OPERATIONS = {
    "percent change": ("A count went from %d to %d. The percent change is", "(b - a) * 100.0D / a"),
    "difference": ("One site has %d plants and another %d. The difference is", "abs(b - a)"),
    "ratio": ("There are %d adults and %d young. Adults for each young:", "a / b"),
    "mean": ("Two plots gave %d and %d seeds. The mean is", "(a + b) / 2"),
    "rate": ("%d visits were seen in %d hours. Visits an hour:", "a / b"),
    "conversion": ("A path is %d km and %d m long. In metres:", "a * 1000 + b"),
    "points": ("Cover rose from %d to %d percent. In points:", "b - a"),
    "total": ("Nets held %d and %d fish. The total is", "a + b"),
    "fraction": ("%d of %d eggs hatched. In percent:", "a * 100.0D / b"),
    "remainder": ("%d leaves are put into groups of %d. Left over:", "a % b"),
}


def arithmetic(rows: DataFrame) -> DataFrame:
    """(id, op, a, b, text, expected) from rows (id, a, b) of positive whole numbers: each asks the operation that its id gives."""
    names = list(OPERATIONS)
    rows = rows.withColumn("op", F.element_at(F.array(*map(F.lit, names)), (F.pmod("id", F.lit(len(names))) + 1).cast("int")))
    text = expected = None
    for name, (wording, formula) in OPERATIONS.items():
        is_op = F.col("op") == name
        text = (F if text is None else text).when(is_op, F.format_string(wording, "a", "b"))
        expected = (F if expected is None else expected).when(is_op, F.round(F.expr(f"cast({formula} as double)"), 6))
    return rows.select("id", "op", "a", "b", text.alias("text"), expected.alias("expected"))


def recomputed(rows: DataFrame) -> Column:
    """Whether the expected value follows from operation and inputs."""
    again = None
    for name, (_, formula) in OPERATIONS.items():
        again = (F if again is None else again).when(F.col("op") == name, F.expr(f"cast({formula} as double)"))
    return F.abs(again - F.col("expected")) < 1e-6


def contrasts(facts: DataFrame) -> DataFrame:
    """(id, family, text, opposite) from facts (id, name, kind, size, above): statements and others that differ in direction, number or polarity alone."""
    turn = F.pmod("id", F.lit(3))
    family = F.when(turn == 0, "direction").when(turn == 1, "number").otherwise("polarity")

    def say(true: bool) -> Column:
        above = F.col("above") if true else ~F.col("above")
        direction = F.concat(F.lit("The price of the "), "name", F.lit(" is "), F.when(above, "above").otherwise("below"), F.lit(" the mean."))
        count = F.concat(F.lit("The "), "name", F.lit(" has size "), (F.col("size") if true else F.col("size") * 3).cast("string"), F.lit("."))
        polarity = F.concat(F.lit("The "), "name", F.lit(" is " if true else " is not "), "kind", F.lit("."))
        return F.when(turn == 0, direction).when(turn == 1, count).otherwise(polarity)

    return facts.select("id", family.alias("family"), say(True).alias("text"), say(False).alias("opposite"))


def syllogisms(facts: DataFrame) -> DataFrame:
    """(id, family, text, valid) from facts (id, member, middle, whole, other): member is of middle, which is in whole and not in other."""
    turn = F.pmod("id", F.lit(4))
    text = (
        F.when(turn == 0, F.format_string("All of %s is in %s. %s is of %1$s. So %3$s is in %2$s.", "middle", "whole", "member"))
        .when(turn == 1, F.format_string("%s is of %s. %2$s is in %s. So %1$s is in %3$s.", "member", "middle", "whole"))
        .when(turn == 2, F.format_string("Nothing of %s is in %s. %s is of %1$s. So %3$s is not in %2$s.", "middle", "other", "member"))
        .otherwise(F.format_string("Some of %s is of %s. %s is in %1$s. So %3$s is of %2$s.", "whole", "middle", "member"))
    )
    family = F.when(turn == 0, "categorical").when(turn == 1, "transitive").when(turn == 2, "negation").otherwise("none")
    return facts.select("id", family.alias("family"), text.alias("text"), (turn != 3).alias("valid"))


def chains(facts: DataFrame, valid_share: float = 0.5, seed: int = 200) -> DataFrame:
    """(id, text, valid): three-step chains over facts as of `syllogisms`, exactly floor(n * valid_share) of which are valid, at random places."""
    n = facts.count()
    rows = in_random_order(facts, F.col("id"), seed).withColumn("valid", F.col("place") < int(n * valid_share))
    end = F.when(F.col("valid"), F.col("whole")).otherwise(F.col("other"))
    return rows.select("id", F.format_string("[OBS] %s is of %s.\n[EVID] %2$s is in %s.\n[CONC] So %1$s is in %s.", "member", "middle", "whole", end).alias("text"), "valid")


def cap_moulds(rows: DataFrame, family: str, mould: str, share: float) -> DataFrame:
    """At most that share of a family's rows from one mould, one row at least; the first by id stay."""
    sizes = rows.groupBy(F.col(family).alias("__of")).agg(F.count("*").alias("__n"))
    placed = running_total(rows, [F.col("id")], F.lit(1), "__r", by=[family, mould]).join(sizes, F.col(family).eqNullSafe(F.col("__of")))
    return placed.where(F.col("__r") < F.greatest(F.lit(1), F.floor(F.col("__n") * share))).select(*rows.columns)


def repairs(calls: DataFrame, prompt: Column, call: str = "call") -> DataFrame:
    """Six documents for each call: one that asks for it, and five that show it damaged (kind says how) and answer with it."""
    c = F.col(call)
    damaged = {"brace": F.regexp_replace(c, "\\}$", ""), "quote": F.regexp_replace(c, '"([a-z_]+)":', "$1:"), "comma": F.replace(c, F.lit(", "), F.lit(" ")), "name": F.regexp_replace(c, '("function": "\\w+)\\w"', '$1"'), "escape": F.replace(c, F.lit('"'), F.lit('\\"'))}
    rows = [F.struct(F.lit("generation").alias("kind"), F.concat(F.lit("[USER] "), prompt, F.lit("\n[ACTION] "), c).alias("document"))]
    rows += [F.struct(F.lit(k).alias("kind"), F.concat(F.lit("[BROKEN] "), d, F.lit("\n[ACTION] "), c).alias("document")) for k, d in damaged.items()]
    return calls.select(*calls.columns, F.explode(F.array(*rows)).alias("r")).select(*calls.columns, "r.*")

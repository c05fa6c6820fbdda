"""Verdicts on evaluation curves: one row for each run from its points (run, step, acc, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def _slope(points: DataFrame, last: int) -> DataFrame:
    """(run, slope): the regression slope over the last `last` points; null for fewer, 0 where all have one step."""
    order = Window.partitionBy("run").orderBy(F.col("step").desc())
    few = points.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= last)  # limited before the exchange
    sums = few.groupBy("run").agg(F.count("*").alias("m"), F.covar_pop("step", "acc").alias("cov"), F.var_pop("step").alias("var"))
    return sums.select("run", F.when(F.col("m") == last, F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(0.0)).alias("slope"))


def curve_verdicts(points: DataFrame, *, go: float, hit: float, ref: float, alpha: float = 0.05) -> DataFrame:
    """(run, looks, final_step, final_acc, wins, p, slope, verdict, peak, p_peak, decided_step).

    `points` has one row for each run and step; points without an accuracy are left out.  Only the last point decides: p is
    the chance of as many wins out of its n by guessing.  p_peak is the chance that the best of so many looks is as good by
    guessing, and decided_step the first step that is significant if alpha is shared among all looks (null if none is).
    """
    rows = points.where("acc is not null").withColumn("wins", F.round(F.col("acc") * F.col("n")).cast("long"))
    rows = rows.withColumn("p", stats.binomial_tail(F.col("wins"), F.col("n")))
    whole = rows.groupBy("run").agg(
        F.count("*").alias("looks"), F.max("acc").alias("peak"), F.max_by(F.struct("step", "acc", "wins", "p"), "step").alias("final"), F.min_by("p", F.struct(-F.col("acc"), "step")).alias("p_single")
    )
    first = rows.join(whole.select("run", "looks"), "run").where(F.col("p") < alpha / F.col("looks")).groupBy("run").agg(F.min("step").alias("decided_step"))
    out = whole.join(_slope(rows, 3), "run").join(first, "run", "left")
    final = F.col("final.acc")
    verdict = stats.point_verdict(final, F.col("final.p"), F.coalesce("slope", F.lit(0.0)), F.lit(True), go=go, hit=hit, ref=ref, alpha=alpha)
    return out.select("run", "looks", F.col("final.step").alias("final_step"), final.alias("final_acc"), F.col("final.wins").alias("wins"), F.col("final.p").alias("p"), "slope", verdict.alias("verdict"), "peak", (1 - F.pow(1 - F.col("p_single"), F.col("looks"))).alias("p_peak"), "decided_step")


def trend_verdict(looks: Column, last: Column, slope: Column, *, start: float = 0.535, hit: float = 0.60, falsify: float = 0.55, least: int = 3) -> Column:
    """The older rule without statistics: thresholds on the last point and the sign of the slope, three points at least."""
    return F.when(looks < least, "INSUFFICIENT").when(last >= hit, "HIT").when((last <= falsify) & (last < start), "FALSIFY").when((last > start) & (last < hit) & (slope > 0), "EXTEND").otherwise("NO-GO")

"""Evaluation statistics over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..sources.io import table
from .registry import query

_WIN = "SELECT l_suppkey AS item, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS k FROM lineitem GROUP BY 1"


def wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("item")).agg(F.count("*").alias("n"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("k"))


_Z = stats.Z95
_CENTRE = f"(k::double / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n)"
_HALF = f"{_Z} * sqrt(k::double / n * (1 - k::double / n) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n)"


@query(f"SELECT item, n, k, round(greatest(0, {_CENTRE} - {_HALF}), 6) AS low, round(least(1, {_CENTRE} + {_HALF}), 6) AS high FROM ({_WIN})")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wins(spark, sf_dir).withColumn("ci", stats.wilson(F.col("k"), F.col("n")))
    return w.select("item", "n", "k", F.round("ci.low", 6).alias("low"), F.round("ci.high", 6).alias("high"))


@query(f"""WITH w AS ({_WIN}), f AS (SELECT i, sum(CASE WHEN i = 0 THEN 0 ELSE ln(i) END) OVER (ORDER BY i) AS lf FROM range(0, (SELECT max(n) + 1 FROM w)::bigint) r(i)),
t AS (SELECT item, n, k, unnest(range(k, n + 1)) AS i FROM w)
SELECT item, round(least(1, sum(exp(a.lf - b.lf - c.lf + n * ln(0.5)))), 6) AS p FROM t JOIN f a ON a.i = n JOIN f b ON b.i = t.i JOIN f c ON c.i = n - t.i GROUP BY item""")
def binomial_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wins(spark, sf_dir).select("item", F.round(stats.binomial_tail(F.col("k"), F.col("n")), 6).alias("p"))


@query("""WITH r AS (SELECT o_orderpriority || '-s' || (o_orderkey % 3) AS run, avg(o_totalprice) AS logic, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS number, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS negation, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT regexp_replace(run, '-s\\d+$', '') AS model, 0.5 * logic + 0.5 * least(number, negation) AS fitness, n FROM r)
SELECT model, count(*) AS replicas, round(avg(fitness), 2) AS fitness, round(stddev_pop(fitness), 2) AS sd, max(n) AS n FROM f GROUP BY model""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicas of a run gathered under its name, by fitness."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    runs = o.groupBy(F.concat("o_orderpriority", F.lit("-s"), F.col("o_orderkey") % 3).alias("run")).agg(F.avg(price).alias("logic"), F.avg(F.when(F.col("o_orderstatus") == "F", price)).alias("number"), F.avg(F.when(F.col("o_orderstatus") == "O", price)).alias("negation"), F.count("*").alias("n"))
    scored = runs.select(F.regexp_replace("run", "-s\\d+$", "").alias("model"), stats.fitness(F.col("logic"), F.col("number"), F.col("negation")).alias("fitness"), "n")
    return scored.groupBy("model").agg(F.count("*").alias("replicas"), F.round(F.avg("fitness"), 2).alias("fitness"), F.round(F.stddev_pop("fitness"), 2).alias("sd"), F.max("n").alias("n"))


@query("WITH s AS (SELECT event_type, avg(value) AS score FROM events GROUP BY 1) SELECT event_type, round(score, 6) AS score, round(score - (SELECT score FROM s WHERE event_type = 'view'), 6) AS delta, CASE WHEN score > (SELECT score FROM s WHERE event_type = 'view') + 0.1 THEN 'GO' ELSE 'NO-GO' END AS decision FROM s")
def go_no_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("score"))
    base = s.where("event_type = 'view'").select(F.col("score").alias("base"))
    both = s.join(base, F.lit(True), "left")
    return both.select("event_type", F.round("score", 6).alias("score"), F.round(F.col("score") - F.col("base"), 6).alias("delta"), F.when(F.col("score") > F.col("base") + 0.1, "GO").otherwise("NO-GO").alias("decision"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, w, list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS g FROM w)
SELECT doc_id, round(1 - len(list_distinct(g)) / greatest(len(g), 1), 6) AS repeated, round(len(list_distinct(w)) / greatest(len(w), 1), 6) AS distinct_words FROM g WHERE len(w) >= 4""")
def repetition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", T.word_list(F.col("text")).alias("w")).where(F.size("w") >= 4)
    g = w.withColumn("g", T.ngrams(F.col("w"), 4))
    share = lambda c: F.size(F.array_distinct(c)) / F.greatest(F.size(c), F.lit(1))
    return g.select("doc_id", F.round(1 - share("g"), 6).alias("repeated"), F.round(share("w"), 6).alias("distinct_words"))


@query("SELECT user_id, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6)::double AS win_rate, round(avg(value - 50), 6) AS mean_delta, count(*) AS n FROM events GROUP BY 1")
def pairwise_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("win_rate"), F.round(F.avg(F.col("value") - 50), 6).alias("mean_delta"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT event_id // 4 AS i FROM events) SELECT i AS step, CASE WHEN i < 500 THEN round(16 + i / 500.0 * 16) WHEN i < 1500 THEN round(32 + (i - 500) / 1000.0 * 32) ELSE 64 END::int AS span,
round(CASE WHEN i < 500 THEN 0.3 + i / 500.0 * 0.3 WHEN i < 1500 THEN 0.6 + (i - 500) / 1000.0 * 0.35 ELSE 0.95 END, 6)::double AS fraction FROM e""")
def curriculum_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span and fraction to mask at each step, four events making a step."""
    steps = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("step")).distinct()
    s = steps.withColumn("s", stats.curriculum(F.col("step"), [(0, 16, 0.3), (500, 32, 0.6), (1500, 64, 0.95)]))
    return s.select("step", "s.span", F.round("s.fraction", 6).alias("fraction"))


@query("""SELECT source, template, n, round(n / sum(n) OVER (PARTITION BY source), 6)::double AS share, n / sum(n) OVER (PARTITION BY source) > 0.05 AS over_limit FROM (SELECT source, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS template, count(*) AS n FROM documents GROUP BY 1, 2)""")
def mould_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each mould (a text whose numbers are left open) among the documents of its source, and whether one makes up too much."""
    n = table(spark, sf_dir, "documents").groupBy("source", F.md5(F.regexp_replace("text", "[0-9]+", "#")).alias("template")).agg(F.count("*").alias("n"))
    total = n.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all")
    return n.join(total, F.col("source").eqNullSafe(F.col("of"))).select("source", "template", "n", F.round(share, 6).alias("share"), (share > 0.05).alias("over_limit"))


@query("""WITH o AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1),
r AS (SELECT 'n_chars' AS op, n_chars = length(text) AS forced FROM documents UNION ALL SELECT 'lines', n = last FROM o UNION ALL SELECT 'total', abs(total - o_totalprice) < 0.01 FROM o JOIN orders ON o_orderkey = l_orderkey)
SELECT op, round(avg(CASE WHEN forced THEN 1.0 ELSE 0.0 END), 6)::double AS forced, count(*) AS n FROM r GROUP BY op""")
def forcedness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a stored value follows from what it is said to be made of: characters of a text, lines and total of an order."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"), F.sum("l_extendedprice").alias("total"))
    checks = table(spark, sf_dir, "documents").select(F.lit("n_chars").alias("op"), (F.col("n_chars") == F.length("text")).alias("forced"))
    checks = checks.unionByName(orders.select(F.lit("lines").alias("op"), (F.col("n") == F.col("last")).alias("forced")))
    paid = orders.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    checks = checks.unionByName(paid.select(F.lit("total").alias("op"), (F.abs(F.col("total") - F.col("o_totalprice")) < 0.01).alias("forced")))
    return checks.groupBy("op").agg(F.round(F.avg(F.col("forced").cast("double")), 6).alias("forced"), F.count("*").alias("n"))


_TAIL = "f AS (SELECT i, sum(CASE WHEN i = 0 THEN 0 ELSE ln(i) END) OVER (ORDER BY i) AS lf FROM range(0, (SELECT max(n) + 1 FROM w)::bigint) r(i)), t AS (SELECT w.*, unnest(range(k, n + 1)) AS i FROM w), q AS (SELECT {0}, n, k, least(1, sum(exp(a.lf - b.lf - c.lf + n * ln(0.5)))) AS p FROM t JOIN f a ON a.i = n JOIN f b ON b.i = t.i JOIN f c ON c.i = n - t.i GROUP BY ALL)"
_STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END"


@query(f"""WITH w AS ({_WIN}), {_TAIL.format("item")}
SELECT item, n, k, {_STARS} AS stars, CASE WHEN item % 5 = 0 THEN 'DIAGNOSTIC' WHEN k / n >= 0.55 AND p < 0.05 THEN 'HIT' WHEN k / n > 0.5 AND p < 0.05 THEN 'EXTEND' WHEN k / n <= 0.45 AND p >= 0.05 THEN 'FALSIFY' ELSE 'NO-GO' END AS verdict FROM q""")
def battery_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wins(spark, sf_dir).withColumn("acc", F.col("k") / F.col("n")).withColumn("p", stats.binomial_tail(F.col("k"), F.col("n")))
    verdict = stats.point_verdict(F.col("acc"), F.col("p"), F.lit(0.01), F.col("item") % 5 != 0, go=0.45, hit=0.55, ref=0.5)
    return w.select("item", "n", "k", stats.stars(F.col("p")).alias("stars"), verdict.alias("verdict"))


@query(f"""WITH w AS (SELECT l_suppkey AS run, 'L' || (l_linenumber - 1) AS level, count(*) AS n, count(*) FILTER (l_discount > 0.045) AS k FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), {_TAIL.format("run, level")},
r AS (SELECT run, CASE WHEN coalesce(bool_or(level = 'L3' AND k / n > 0.55 AND p < 0.05), false) THEN 'INFERENTIAL_SIGNAL' WHEN bool_or(level = 'L2' AND k / n > 0.55 AND p < 0.05) THEN 'STAGE_GRAMMAR' WHEN bool_or(level IN ('L0', 'L1') AND k / n > 0.55) THEN 'TOPICAL_SHORTCUT' ELSE 'STRONG_FALSIFY' END AS reading FROM q GROUP BY run)
SELECT run, level, n, k, round(p, 6) AS p, {_STARS} AS stars, reading FROM q JOIN r USING (run)""")
def battery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines as a run of four levels: accuracy and chance of each level, and what they say together."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    w = rows.groupBy(F.col("l_suppkey").alias("run"), F.concat(F.lit("L"), F.col("l_linenumber") - 1).alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.045).alias("k"))
    w = w.withColumn("acc", F.col("k") / F.col("n")).withColumn("p", stats.binomial_tail(F.col("k"), F.col("n")))
    levels = ("L0", "L1", "L2", "L3")
    at = {c: {v: F.max(F.when(F.col("level") == v, F.col(c))) for v in levels} for c in ("acc", "p")}
    readings = w.groupBy("run").agg(stats.battery_reading(at["acc"], at["p"]).alias("reading"))
    return w.join(readings, "run").select("run", "level", "n", "k", F.round("p", 6).alias("p"), stats.stars(F.col("p")).alias("stars"), "reading")

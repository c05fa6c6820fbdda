"""Aggregates, windows, samples and similarity over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, order, select, similarity
from ..sources.io import build_report, table
from .registry import query


@query("""SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'size', (length(text) // 1000)::varchar, count(*) FROM documents GROUP BY 2""")
def group_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by each of several dimensions from one scan: grouping sets rather than a query for each."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.floor(F.length("text") / 1000).cast("string").alias("size"))
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in ("lang", "source", "size")])
    return docs.select(F.explode(pairs).alias("p")).groupBy("p.dim", "p.value").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS big_users FROM events GROUP BY event_type")
def conditional_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("big_users"))


@query("SELECT lang, length(text) > 2000 AS long, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM documents GROUP BY 1, 2")
def counts_by_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", (F.length("text") > 2000).alias("long")).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


_P = (0.1, 0.25, 0.5, 0.75, 0.9)


@query("SELECT lang, " + ", ".join(f"round(quantile_cont(n::double, {p}), 4) AS p{int(p * 100)}" for p in _P) + " FROM (SELECT lang, length(text) AS n FROM documents) GROUP BY lang")
def percentiles_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("double").alias("n")).groupBy("lang").agg(F.percentile("n", list(_P)).alias("p"))
    return docs.select("lang", *[F.round(F.get("p", F.lit(i)), 4).alias(f"p{int(p * 100)}") for i, p in enumerate(_P)])


@query("""SELECT count(*) AS scanned, count(*) FILTER (length(text) < 200) AS short, (count(*) - count(DISTINCT md5(text)))::bigint AS duplicates, sum(length(text) // 4)::bigint AS tokens,
count(*) FILTER (lang = 'en') AS english FROM documents""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("n"), F.sum((F.length("text") < 200).cast("long")).alias("short"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.sum((F.col("lang") == "en").cast("long")).alias("english"))
    return docs.agg(F.sum("n").alias("scanned"), F.sum("short").alias("short"), (F.sum("n") - F.count("*")).alias("duplicates"), F.sum("tokens").alias("tokens"), F.sum("english").alias("english"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS sd, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def replica_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.round(F.stddev_pop("l_quantity"), 4).alias("sd"), F.max("l_quantity").alias("high"))


@query("SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::double AS share FROM events GROUP BY 1")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("""SELECT term, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,12}')) AS term FROM documents) GROUP BY term HAVING count(*) >= 5""")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,12}"), F.lit(0)))
    return table(spark, sf_dir, "documents").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("docs")).where("docs >= 5")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 40")
def quota_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], [F.col("doc_id")], 40)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':13')) AS r FROM documents) WHERE r <= 40")
def quota_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], F.col("doc_id"), 40, 13)


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, t, sum(t) OVER (PARTITION BY lang ORDER BY md5(doc_id || ':5') ROWS UNBOUNDED PRECEDING) AS run, sum(t) OVER (PARTITION BY lang) AS total
FROM (SELECT doc_id, lang, length(text) // 4 AS t FROM documents)) WHERE run - t < total * 0.25""")
def token_mass_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", T.token_estimate(F.col("text")).alias("t"))
    return select.mass_fraction(docs, ["lang"], [select.draw(F.col("doc_id"), 5)], F.col("t"), 0.25).select("doc_id", "lang")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= greatest(1, floor(n * 0.1))")
def top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n_text"))
    return select.top_fraction(docs, ["source"], [F.col("n_text").desc(), F.col("doc_id")], 0.1).select("doc_id", "source")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(CASE WHEN length(text) >= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bad FROM conversations) WHERE bad = 0""")
def valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return select.valid_prefix(c, ["conv_id"], [F.col("turn")], F.coalesce(F.length("text") >= 60, F.lit(False))).select("conv_id", "turn")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE (r - 1) % 10 = 0 OR r = n")
def every_n_plus_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.every_nth(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], [F.col("event_id")], 10)


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS z FROM events)
SELECT user_id, max(value) AS peak, round(avg(value) FILTER (a <= 3), 6) AS first3, round(avg(value) FILTER (z <= 3), 6) AS last3, round(regr_slope(value, a::double) FILTER (z <= 3), 6) AS slope FROM r GROUP BY user_id HAVING count(*) >= 6""")
def peak_and_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    e = select.ranked(select.ranked(e, ["user_id"], [F.col("event_id")], "a"), ["user_id"], [F.col("event_id").desc()], "z")
    last = F.col("z") <= 3
    out = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("peak"), F.round(F.avg(F.when(F.col("a") <= 3, F.col("value"))), 6).alias("first3"), F.round(F.avg(F.when(last, F.col("value"))), 6).alias("last3"), F.round(F.regr_slope(F.when(last, F.col("value")), F.when(last, F.col("a").cast("double"))), 6).alias("slope"))
    return out.where("n >= 6").drop("n")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || ':42')) <= floor(count(*) OVER () * 0.95) THEN 'train' ELSE 'valid' END AS part FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.split_exact(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 0.95, 42)


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), q AS (SELECT source, least(n, least(greatest(floor(n * 300 / sum(n) OVER ()), 5), 100)) AS quota FROM s)
SELECT doc_id, d.source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':3')) AS r FROM documents) d JOIN q USING (source) WHERE r <= quota""")
def proportional_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return select.proportional_quota(docs, "source", [select.draw(F.col("doc_id"), 3)], 300, 5, 1 / 3).select("doc_id", "source")


@query("""WITH p AS (SELECT doc_id, contains(text, chr(10)) AS structured, row_number() OVER (PARTITION BY contains(text, chr(10)) ORDER BY md5(doc_id || ':9')) AS r FROM documents),
a AS (SELECT doc_id FROM p WHERE structured AND r <= 100) SELECT doc_id, true AS structured FROM a UNION ALL SELECT doc_id, false FROM p WHERE NOT structured AND r <= 150 - (SELECT count(*) FROM a)""")
def dual_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured documents first, others for what is missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("\n")).alias("structured"))
    first = docs.where("structured").orderBy(select.draw(F.col("doc_id"), 9)).limit(100)
    rest = docs.where("not structured").orderBy(select.draw(F.col("doc_id"), 9)).limit(150)
    n = first.agg(F.count("*").alias("n"))
    rest = rest.withColumn("r", F.row_number().over(Window.orderBy(select.draw(F.col("doc_id"), 9)))).crossJoin(n).where("r <= 150 - n").select("doc_id", "structured")
    return first.unionByName(rest)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE (r - 1) % 25 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 25th row in id order."""
    placed = order.running_total(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], F.lit(1), "place")
    return placed.where("place % 25 = 0").select("doc_id")


@query("""WITH d AS (SELECT doc_id, length(text) // 4 AS t FROM documents), k AS (SELECT floor(20000 / avg(t)) AS k FROM d)
SELECT doc_id, t AS tokens FROM (SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':21')) AS r FROM d) WHERE r <= (SELECT k FROM k)""")
def token_budget_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many random rows as the mean size allows for the budget: a top-k, which the engine cuts within tasks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    k = int(docs.agg(F.floor(20000 / F.avg("tokens"))).first()[0] or 0)
    return docs.orderBy(select.draw(F.col("doc_id"), 21)).limit(k)


@query("""WITH k AS (SELECT ceil(round(0.3 / 0.7 * count(*) FILTER (lang <> 'es')) / count(*) FILTER (lang = 'es'))::bigint AS k FROM documents)
SELECT doc_id, unnest(range(1, CASE WHEN lang = 'es' THEN k ELSE 1 END + 1)) AS copy FROM documents, k""")
def upsample_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many copies of the Spanish documents as give them three tenths of the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = docs.agg(F.count_if(F.col("lang") != "es").alias("base"), F.count_if(F.col("lang") == "es").alias("extra")).first()
    last = F.when(F.col("lang") == "es", select.copies_for_share(n.base, n.extra, 0.3)).otherwise(1).cast("long")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("copy"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


_DOT = "list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[]))"
_KNN = f"SELECT a.vec_id AS src, b.vec_id AS dst, {_DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 12) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"


@query(f"SELECT src, dst, round(s, 4) AS sim, rank::int AS rank FROM ({_KNN}) WHERE rank <= 3")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return similarity.top_k(v, v, 3).select("src", "dst", F.round("sim", 4).alias("sim"), "rank")


@query(f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(s), 4) AS sim FROM ({_KNN}) WHERE rank <= 5 GROUP BY 1, 2")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return dedup.canonical_edges(similarity.top_k(v, v, 5)).select("a", "b", F.round("sim", 4).alias("sim"))


@query(f"SELECT src, round(avg(s), 4) AS con FROM ({_KNN}) WHERE rank <= 8 GROUP BY src")
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return similarity.connectivity(similarity.top_k(v, v, 8)).select("src", F.round("con", 4).alias("con"))


@query(f"""SELECT src, dst, round(s, 4) AS sim, s > 0.3 AS leaked FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {_DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 12) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id % 10 <> 0 AND b.vec_id % 10 = 0) WHERE rank = 1""")
def leakage_max_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    out = similarity.leakage(v.where("id % 10 <> 0"), v.where("id % 10 = 0"), 0.3)
    return out.select("src", "dst", F.round("sim", 4).alias("sim"), "leaked")


def checkpoint(spark: SparkSession):
    import tempfile

    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="corpusmill-"))
    return lambda df: df.checkpoint(eager=True)


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM ({_KNN}) WHERE s >= 0.4), u AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.node, u.dst FROM reach JOIN u ON reach.seen = u.src)
SELECT node AS vec_id, min(seen) AS component, min(seen) = node AS kept FROM reach GROUP BY node""")
def semantic_dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    labels = dedup.components(similarity.links(v, 0.4, connect=True), v.select(F.col("id").alias("node")), checkpoint(spark))
    return labels.select(F.col("node").alias("vec_id"), "component", (F.col("node") == F.col("component")).alias("kept"))


@query()
def semantic_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.greedy_representatives(vectors(spark, sf_dir), 0.35).select(F.col("node").alias("vec_id"), "kept")


_COUNTS = "SELECT '{0}' AS dim, string_agg('{{\"value\":\"' || v || '\",\"n\":' || n || '}}', ',' ORDER BY v) AS counts FROM (SELECT coalesce({0}, '') AS v, count(*) AS n FROM documents GROUP BY 1)"


@query(f"""SELECT '[' || string_agg('{{"dim":"' || dim || '","counts":[' || counts || ']}}', ',' ORDER BY dim) || ']' AS report FROM ({_COUNTS.format("lang")} UNION ALL {_COUNTS.format("source")})""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_report(table(spark, sf_dir, "documents"), ["lang", "source"])

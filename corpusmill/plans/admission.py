"""What enters a corpus: layers with defaults, reasons to reject, filtered search, dialogue splits and reports on runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import prompts, stats
from ..functions import text as T
from ..operators import dedup, search, select
from ..sources.io import table
from .corpus import _CLASS, _CODE, HASH_SQL
from .extras import _TERMS
from .registry import query

_LAYERS = (("first", "source < 'src13'", "mixed"), ("second", "source >= 'src13' AND source < 'src4'", "plain"), ("third", "source >= 'src4'", "late"))


@query(f"""WITH l AS ({" UNION ALL ".join(f"SELECT {i} AS n, '{name}' AS layer, doc_id, coalesce(nullif(lang, 'en'), '{tag}') AS tag, CASE WHEN length(text) < 50 THEN NULL ELSE {HASH_SQL} END AS k FROM documents WHERE {where}" for i, (name, where, tag) in enumerate(_LAYERS))})
SELECT layer, doc_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, doc_id) AS r FROM l WHERE k IS NOT NULL) WHERE r = 1""")
def layered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers, each with its own default tag, as one corpus: the earliest layer keeps a text, the smallest id within it; short texts have no key and go."""
    docs = table(spark, sf_dir, "documents")
    layers = [docs.where(where).select(F.lit(i).alias("n"), F.lit(name).alias("layer"), "doc_id", F.coalesce(F.nullif("lang", F.lit("en")), F.lit(tag)).alias("tag"), F.when(F.length("text") >= 50, T.content_hash(F.col("text"))).alias("k")) for i, (name, where, tag) in enumerate(_LAYERS)]
    return dedup.first_per_key(reduce(DataFrame.unionByName, layers), F.col("k"), [F.col("n"), F.col("doc_id")]).select("layer", "doc_id", "tag")


_NAMES = ("token", "password", "Version 2.0", "@example")


@query(f"""WITH d AS (SELECT source, text, {_CODE.format("text")} AS code FROM documents), r AS (SELECT source, CASE WHEN code IS NOT NULL AND {_CLASS} <> 'open' THEN 'licence' WHEN {" OR ".join(f"contains(text, '{n}')" for n in _NAMES)} THEN 'name' WHEN length(text) < 100 THEN 'short' WHEN NOT (contains(text, '. ') OR contains(text, chr(10))) THEN 'plain' ELSE 'kept' END AS outcome FROM d)
SELECT source, outcome, count(*) AS docs, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6)::double AS share FROM r GROUP BY 1, 2""")
def admission_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason to reject each document (its licence, a name that must not occur, its length, a missing fragment), by source."""
    code = L.license_code(F.col("text"))
    named = reduce(lambda a, n: a | F.contains("text", F.lit(n)), _NAMES, F.lit(False))
    fragments = F.contains("text", F.lit(". ")) | F.contains("text", F.lit("\n"))
    outcome = F.when(code.isNotNull() & (L.license_class(code) != "open"), "licence").when(named, "name").when(F.length("text") < 100, "short").when(~fragments, "plain").otherwise("kept")
    counts = table(spark, sf_dir, "documents").groupBy("source", outcome.alias("outcome")).agg(F.count("*").alias("docs"))
    total = counts.groupBy(F.col("source").alias("of")).agg(F.sum("docs").alias("all"))
    return counts.join(total, F.col("source").eqNullSafe(F.col("of"))).select("source", "outcome", "docs", F.round(F.col("docs") / F.col("all"), 6).alias("share"))


@query(f"""WITH t AS (SELECT id, term, size, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL), h AS (SELECT * FROM t WHERE term IN ('license', 'apache') OR term LIKE 'releas%'), d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
n AS (SELECT count(*) AS docs, avg(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS mean FROM documents), s AS (SELECT id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM h JOIN d USING (term), n GROUP BY id)
SELECT id, round(score, 6) AS score FROM s JOIN documents ON doc_id = id WHERE lang = 'en' AND n_chars BETWEEN 100 AND 5000 ORDER BY round(score, 9) DESC, id LIMIT 10""".replace("{{", "{").replace("}}", "}"))
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-10 report by BM25 over all documents, among those of one language and a range of lengths."""
    docs = table(spark, sf_dir, "documents")
    fits = docs.where("lang = 'en' and n_chars between 100 and 5000").select(F.col("doc_id").alias("id"))
    return search.search(docs, ["license", "apache", "releas*"], among=fits, k=10).select("id", F.round("score", 6).alias("score"))


_W = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


@query(f"""WITH s AS (SELECT conv_id, string_agg('[' || upper(role) || '] ' || trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, t, length(t) - strpos(reverse(t), reverse('[ASSISTANT]')) - 9 AS pos FROM s WHERE contains(t, '[ASSISTANT]')),
q AS (SELECT conv_id, regexp_replace(t[:pos - 1], '[ \\t\\n\\x0B\\f\\r]+$', '') AS prompt, t[pos + 12:] AS response FROM p)
SELECT conv_id, length(prompt) AS prompt_chars, md5(response) AS response_md5, {_W.format("prompt")}[-12:] AS tail, {_W.format("response")}[:8] AS head, CASE WHEN contains(response[:200], '. ') THEN response[:length(response[:200]) - strpos(reverse(response[:200]), ' .')] ELSE response[:200] END AS explanation FROM q""")
def dialogue_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each serialised conversation split at its last answer: the prompt, the end of it and the beginning of the answer, and a short explanation."""
    turn = F.concat(F.lit("["), F.upper("role"), F.lit("] "), T.normal_space(F.col("text")))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("line")))), lambda x: x["line"]), "\n").alias("t"))
    parts = whole.select("conv_id", prompts.split_at_last(F.col("t"), "[ASSISTANT]", "response").alias("p")).where("p.prompt is not null").select("conv_id", "p.prompt", F.regexp_replace("p.response", "^\\[ASSISTANT\\] ?", "").alias("response"))
    tail, head = prompts.tail_and_head(F.col("prompt"), F.col("response"), 12, 8)
    return parts.select("conv_id", F.length("prompt").alias("prompt_chars"), F.md5("response").alias("response_md5"), tail.alias("tail"), head.alias("head"), prompts.explanation(F.col("response"), 200).alias("explanation"))


_ES, _EN = ("de", "la", "que", "en", "los", "una", "por", "las"), ("the", "of", "and", "in", "to", "that", "was", "are")


@query(f"""WITH w AS (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '[a-záéíóúüñ]+') AS w FROM documents),
v AS (SELECT lang, CASE WHEN len(list_filter(w, lambda x: x IN {_ES})) + 2 * len(regexp_extract_all(text, '[¿¡ñ]')) > len(list_filter(w, lambda x: x IN {_EN})) THEN 'es' ELSE 'en' END AS vote FROM w) SELECT lang, vote, count(*) AS docs FROM v GROUP BY 1, 2""")
def word_language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    vote = prompts.word_language(F.col("text"), _ES, _EN)
    return table(spark, sf_dir, "documents").groupBy("lang", vote.alias("vote")).agg(F.count("*").alias("docs"))


@query("""WITH r AS (SELECT event_type || '-s' || user_id AS run, avg(value) FILTER (event_id % 4 = 0) AS logic, avg(value) FILTER (event_id % 4 = 1) AS number, avg(value) FILTER (event_id % 4 = 2) AS negation FROM events GROUP BY 1),
f AS (SELECT run, split_part(run, '-s', 1) AS model, split_part(run, '-s', 2)::bigint AS replica, 0.5 * logic + 0.5 * least(number, negation) AS fitness FROM r WHERE logic IS NOT NULL AND (number IS NOT NULL OR negation IS NOT NULL))
SELECT model, replica, round(fitness, 6) AS fitness, place FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(fitness, 9) DESC, replica) AS place FROM f) WHERE place <= 2""")
def two_fittest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two fittest replicas of each model, by number where they tie; runs without a fitness do not count."""
    part = lambda i: F.avg(F.when(F.col("event_id") % 4 == i, F.col("value")))
    runs = table(spark, sf_dir, "events").groupBy(F.concat("event_type", F.lit("-s"), "user_id").alias("run")).agg(part(0).alias("logic"), part(1).alias("number"), part(2).alias("negation"))
    scored = runs.select(F.substring_index("run", "-s", 1).alias("model"), F.substring_index("run", "-s", -1).cast("long").alias("replica"), stats.fitness(F.col("logic"), F.col("number"), F.col("negation")).alias("fitness")).where("fitness is not null")
    return select.ranked(scored, ["model"], [F.round("fitness", 9).desc(), F.col("replica")], "place").where("place <= 2").withColumn("fitness", F.round("fitness", 6))


@query("""SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) FILTER (event_id % 4 = 0), 6)::double AS r0, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) FILTER (event_id % 4 = 1), 6)::double AS r1, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) FILTER (event_id % 4 = 2), 6)::double AS r2, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) FILTER (event_id % 4 = 3), 6)::double AS r3 FROM events GROUP BY 1""")
def corruption_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each kind of item at four rates of corruption, which the items' numbers deal out."""
    right = (F.col("value") > 10).cast("double")
    rates = [F.round(F.avg(F.when(F.col("event_id") % 4 == i, right)), 6).alias(f"r{i}") for i in range(4)]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), *rates)

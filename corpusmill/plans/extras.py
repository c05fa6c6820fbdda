"""Search, entities, contrast pairs and generators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import literal_span
from ..functions.structure import turn_pairs
from ..operators import dedup, pairs, search, select, similarity, synth
from ..sources.io import shard_of, table
from . import analysis
from .registry import query

_TERMS = "SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS size FROM documents"


@query(f"""WITH t AS (SELECT id, term, size, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL), h AS (SELECT * FROM t WHERE term IN ('license', 'rights') OR term LIKE 'copyr%'), d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
n AS (SELECT count(*) AS docs, avg(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS mean FROM documents)
SELECT id, round(score, 6) AS score FROM (SELECT id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM h JOIN d USING (term), n GROUP BY id) ORDER BY round(score, 9) DESC, id LIMIT 50""".replace("{{", "{").replace("}}", "}"))
def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-50 report by BM25."""
    return search.search(table(spark, sf_dir, "documents"), ["license", "rights", "copyr*"]).select("id", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,} [a-z]{4,}')) AS name FROM documents), n AS (SELECT doc_id, name, count(*) AS mentions FROM c WHERE length(name) BETWEEN 10 AND 40 GROUP BY 1, 2)
SELECT name, count(*) AS docs, sum(mentions)::bigint AS mentions FROM n GROUP BY name HAVING count(*) >= 3""")
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word names by the documents and places that have them."""
    names = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,} [a-z]{4,}"), F.lit(0))).alias("name")).where(F.length("name").between(10, 40))
    return names.groupBy("doc_id", "name").agg(F.count("*").alias("m")).groupBy("name").agg(F.count("*").alias("docs"), F.sum("m").alias("mentions")).where("docs >= 3")


@query("""SELECT a AS left_term, b AS right_term, count(*) AS docs FROM (SELECT list_filter(['tion', 'ment', 'ung', 'ado', 'ing'], lambda t: contains(lower(text), t)) AS ts FROM documents) d, unnest(['tion', 'ment', 'ung', 'ado', 'ing']) x(a), unnest(['tion', 'ment', 'ung', 'ado', 'ing']) y(b)
WHERE list_contains(ts, a) AND list_contains(ts, b) AND a < b GROUP BY 1, 2""")
def vocabulary_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary terms that documents contain, and pairs of them in one document: arrays of a row, no join."""
    found = F.array_compact(F.array(*[F.when(F.lower("text").contains(t), F.lit(t)) for t in ("tion", "ment", "ung", "ado", "ing")]))
    rows = table(spark, sf_dir, "documents").select(found.alias("ts")).select("ts", F.explode("ts").alias("left_term"))
    both = rows.select("left_term", F.explode("ts").alias("right_term")).where("left_term < right_term")
    return both.groupBy("left_term", "right_term").agg(F.count("*").alias("docs"))


#: Words of the invented prose that give way to each other.
_PROSE = {"direction": [("from", "to"), ("with", "for")], "temporal": [("this", "that"), ("was", "are")], "environment": [("und", "der"), ("les", "la")]}


def _mutation_sql(words: str) -> str:
    """The first mutation of a list of words, as a struct of kind, place, old and new."""
    core = f"regexp_replace(w, '^{pairs.PUNCTUATION}+|{pairs.PUNCTUATION}+$', '', 'g')"
    every = f"list_transform({words}, lambda w, i: {{'i': i - 1, 'old': {core}}})"

    def first(kind: str, applies: str, new: str) -> str:
        return f"list_transform(list_filter({every}, lambda f: {applies})[1:1], lambda f: {{'kind': '{kind}', 'place': f.i, 'old': f.old, 'new': {new}}})[1]"

    tries = []
    for kind, some in _PROSE.items():
        table = pairs.swap_table(some)
        new = "CASE lower(f.old) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"
        tries.append(first(kind, f"lower(f.old) IN ({', '.join(f"'{a}'" for a in table)})", f"CASE WHEN regexp_matches(f.old, '^[A-Z]') THEN upper(left({new}, 1)) || substr({new}, 2) ELSE {new} END"))
    tries.append(first("number", "regexp_matches(f.old, '^[0-9]{1,19}$')", "(f.old::decimal(20,0)::hugeint * 3)::varchar"))
    tries.append(first("digits", "regexp_matches(f.old, '^[0-9]{20,}$')", "left(f.old, -1) || ((right(f.old, 1)::int + 1) % 10)"))
    tries.append(first("negation", f"lower(f.old) IN {pairs.AUXILIARIES}", "f.old || ' not'"))
    return f"coalesce({', '.join(tries)})"


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_MADE = "list_transform({0}, lambda w, i: CASE WHEN i - 1 = m.place THEN replace(w, m.old, m.new) ELSE w END)"


_RING = "SELECT x.doc_id, x.level, x.ctx, x.ok, y.ok AS bad FROM {0} x JOIN {0} y ON {1} AND y.r = (x.r + 1) % x.n WHERE x.n > 1"


@query(f"""WITH w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, source, w, len(w) // 3 AS n FROM w WHERE len(w) >= 12),
c AS (SELECT doc_id, source, w[1:n] AS ctx, w[n + 1:2 * n] AS ok, w[2 * n + 1:3 * n] AS later FROM p), a AS (SELECT 'L0' AS level, *, row_number() OVER (ORDER BY md5(doc_id || ':1'), doc_id) - 1 AS r, count(*) OVER () AS n FROM c),
b AS (SELECT 'L1' AS level, *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':1'), doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM c),
l AS ({_RING.format("a", "true")} UNION ALL {_RING.format("b", "y.source IS NOT DISTINCT FROM x.source")} UNION ALL SELECT doc_id, 'L2', ctx, ok, later FROM c
UNION ALL SELECT doc_id, 'L3', ctx, ok, {_MADE.format("ok")} FROM (SELECT *, {_mutation_sql("ok")} AS m FROM c) WHERE m IS NOT NULL),
j AS (SELECT level, len(list_intersect(list_distinct(ctx), list_distinct(ok))) / greatest(1, len(list_distinct(ctx || ok))) AS o, len(list_intersect(list_distinct(ctx), list_distinct(bad))) / greatest(1, len(list_distinct(ctx || bad))) AS d FROM l)
SELECT level, count(*) AS pairs, round(avg(o), 6) AS to_ok, round(avg(d), 6) AS to_bad, round(avg(o - d), 6) AS margin FROM j GROUP BY level""")
def pair_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.overlap(pairs.levels(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), tables=_PROSE))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), x AS (SELECT doc_id, w, {_mutation_sql("w")} AS m FROM d)
SELECT doc_id, m.kind AS kind, m.place::int AS place, m.old AS old, m.new AS new, md5(array_to_string({_MADE.format("w")}, ' ')) AS mutated_md5 FROM x WHERE m IS NOT NULL""")
def swap_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its first mutation that applies, by tables of words of the prose, numbers and negation."""
    words = table(spark, sf_dir, "documents").select("doc_id", T.word_list(F.col("text")).alias("w"))
    rows = pairs.mutated(words, "w", _PROSE)
    return rows.select("doc_id", "m.kind", "m.place", "m.old", "m.new", F.md5(F.array_join(pairs.with_mutation(F.col("w"), F.col("m")), " ")).alias("mutated_md5"))


_ARITH = "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity::bigint + 1 AS a, l_partkey % 97 + 3 AS b FROM lineitem"


def _operations_sql() -> str:
    """Wordings and results by the place of the operation."""
    names = list(synth.OPERATIONS)
    op = "CASE id % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
    text = "CASE id % 10 " + " ".join(f"WHEN {i} THEN printf('{synth.OPERATIONS[n][0]}', a, b)" for i, n in enumerate(names)) + " END"
    value = "CASE id % 10 " + " ".join(f"WHEN {i} THEN ({synth.OPERATIONS[n][1].replace('100.0D', '100.0::double')})::double" for i, n in enumerate(names)) + " END"
    return f"SELECT id, {op} AS op, a, b, {text} AS text, round({value}, 6) AS expected, true AS forced FROM ({_ARITH})"


@query(_operations_sql())
def arith_cloze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question from each order line, with its answer and whether the answer follows."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity").cast("long") + 1).alias("a"), (F.col("l_partkey") % 97 + 3).alias("b"))
    rows = synth.arithmetic(lines)
    return rows.withColumn("forced", synth.recomputed(rows))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, their nations, the regions of these, and the region that comes next."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    other = r.select(F.pmod(F.col("r_regionkey") + 4, F.lit(5)).alias("n_regionkey"), F.col("r_name").alias("other"))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(other, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("middle"), F.col("r_name").alias("whole"), "other")
    return table(spark, sf_dir, "customer").join(places, "c_nationkey").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("member"), "middle", "whole", "other")


_FACTS = "SELECT c_custkey AS id, c_name AS member, n_name AS middle, r.r_name AS whole, o.r_name AS other FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = n_regionkey JOIN region o ON (o.r_regionkey + 4) % 5 = n_regionkey"


@query(f"""WITH f AS ({_FACTS}), p AS (SELECT *, row_number() OVER (ORDER BY md5(id || ':200'), id) - 1 < floor(count(*) OVER () * 0.4) AS valid FROM f)
SELECT id, '[OBS] ' || member || ' is of ' || middle || '.' || chr(10) || '[EVID] ' || middle || ' is in ' || whole || '.' || chr(10) || '[CONC] So ' || member || ' is in ' || CASE WHEN valid THEN whole ELSE other END || '.' AS text, valid FROM p""")
def logic_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each customer; exactly two fifths of them are valid."""
    return synth.chains(facts(spark, sf_dir), 0.4)


@query(f"""WITH f AS ({_FACTS}), s AS (SELECT id, CASE id % 4 WHEN 0 THEN 'categorical' WHEN 1 THEN 'transitive' WHEN 2 THEN 'negation' ELSE 'none' END AS family, CASE id % 4 WHEN 0 THEN 'All of ' || middle || ' is in ' || whole || '. ' || member || ' is of ' || middle || '. So ' || member || ' is in ' || whole || '.'
WHEN 1 THEN member || ' is of ' || middle || '. ' || middle || ' is in ' || whole || '. So ' || member || ' is in ' || whole || '.' WHEN 2 THEN 'Nothing of ' || middle || ' is in ' || other || '. ' || member || ' is of ' || middle || '. So ' || member || ' is not in ' || other || '.'
ELSE 'Some of ' || whole || ' is of ' || middle || '. ' || member || ' is in ' || whole || '. So ' || member || ' is of ' || middle || '.' END AS text, id % 4 <> 3 AS valid, middle FROM f),
m AS (SELECT *, row_number() OVER (PARTITION BY family, middle ORDER BY id) AS r, count(*) OVER (PARTITION BY family) AS n FROM s) SELECT id, family, text, valid FROM m WHERE r <= greatest(1, floor(n * 0.03))""")
def syllogisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllogisms about customers; no nation may make up more than three in a hundred of a family."""
    f = facts(spark, sf_dir)
    rows = synth.syllogisms(f).join(f.select("id", "middle"), "id")
    return synth.cap_moulds(rows, "family", "middle", 0.03).drop("middle")


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'direction' WHEN 1 THEN 'number' ELSE 'polarity' END AS family, CASE p_partkey % 3 WHEN 0 THEN 'The price of the ' || p_name || ' is ' || CASE WHEN p_retailprice > m THEN 'above' ELSE 'below' END || ' the mean.' WHEN 1 THEN 'The ' || p_name || ' has size ' || p_size || '.' ELSE 'The ' || p_name || ' is ' || lower(p_type) || '.' END AS text,
CASE p_partkey % 3 WHEN 0 THEN 'The price of the ' || p_name || ' is ' || CASE WHEN p_retailprice > m THEN 'below' ELSE 'above' END || ' the mean.' WHEN 1 THEN 'The ' || p_name || ' has size ' || p_size * 3 || '.' ELSE 'The ' || p_name || ' is not ' || lower(p_type) || '.' END AS opposite FROM part, (SELECT avg(p_retailprice) AS m FROM part)""")
def contrast_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement about each part, and one that differs in a single point and is false."""
    parts = table(spark, sf_dir, "part")
    mean = parts.agg(F.avg("p_retailprice").alias("m"))  # one row
    rows = parts.join(F.broadcast(mean), F.lit(True)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.col("p_size").alias("size"), (F.col("p_retailprice") > F.col("m")).alias("above"))
    return synth.contrasts(rows)


_CALL = "'{\"function\": \"' || event_type || '\", \"args\": ' || props || '}'"
_DAMAGED = {"brace": "regexp_replace(call, '\\}$', '')", "quote": "regexp_replace(call, '\"([a-z_]+)\":', '\\1:', 'g')", "comma": "replace(call, ', ', ' ')", "name": "regexp_replace(call, '(\"function\": \"\\w+)\\w\"', '\\1\"', 'g')", "escape": "replace(call, '\"', '\\\"')"}


@query(f"""WITH c AS (SELECT event_id, event_type, {_CALL} AS call FROM events) SELECT event_id, 'generation' AS kind, '[USER] Log a ' || event_type || chr(10) || '[ACTION] ' || call AS document FROM c
{" ".join(f"UNION ALL SELECT event_id, '{k}', '[BROKEN] ' || {d} || chr(10) || '[ACTION] ' || call FROM c" for k, d in _DAMAGED.items())}""")
def call_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training documents on each event's call: one to generate it, five to repair it."""
    calls = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit('{"function": "'), "event_type", F.lit('", "args": '), "props", F.lit("}")).alias("call"))
    return synth.repairs(calls, F.concat(F.lit("Log a "), "event_type")).select("event_id", "kind", "document")


@query()
def hard_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents whose numbers differ, two pairs for each at most, the nearest first; vector ids stand for documents."""
    v = analysis.vectors(spark, sf_dir)
    edges = dedup.canonical_edges(similarity.top_k(v, v, 8, least=0.2))
    # A count that can be null would get a filter before the joins that splits each text once more; nulls have no numbers and go with those below.
    words = F.coalesce(F.size(F.split("text", "\\s+")), F.lit(0))
    nums = table(spark, sf_dir, "documents").select("doc_id", words.alias("n"), T.numbers(F.col("text")).alias("nums"))
    sides = edges.join(nums.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("nums").alias("x")), "a").join(nums.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("nums").alias("y")), "b")
    only = F.when(F.size(F.array_except("x", "y")) > 0, F.array_except("x", "y")).otherwise(F.array_except("y", "x"))
    kept = sides.where((F.size(only) > 0) & (F.col("na") + F.col("nb") <= 2000)).select("a", "b", "sim")
    return dedup.cap_degrees(kept, 2, analysis.checkpoint(spark)).select("a", "b", F.round("sim", 4).alias("sim"))


@query()
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each assistant's turn that the user's turn before it has literally, two for each conversation at most."""

    @F.pandas_udf("string")
    def span(a: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([literal_span(x or "", y or "") for x, y in zip(a, q, strict=True)], dtype="object")

    rows = turn_pairs(table(spark, sf_dir, "conversations"))
    found = rows.withColumn("span", span("a", "q")).withColumn("exact", F.col("span") == F.col("a"))
    return select.ranked(found, ["conv_id"], [F.col("span").isNull(), F.col("turn")], "n").where("n <= 2").select("conv_id", "turn", "span", "exact")


@query("""SELECT doc_id, source FROM documents WHERE source = 'src2' UNION ALL SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source <> 'src2') WHERE r % 50 = 0""")
def anchor_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of one source and one in fifty of each other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rest = select.ranked(docs.where("source <> 'src2'"), ["source"], [F.col("doc_id")], "r").where("r % 50 = 0").drop("r")
    return docs.where("source = 'src2'").unionByName(rest)


@query("""WITH d AS (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) > 1 AS dup, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':4')) AS r, lang FROM documents)
SELECT lang, count(*) AS sampled, round(avg(CASE WHEN dup THEN 1.0 ELSE 0.0 END), 6)::double AS dup_rate FROM d WHERE r <= 60 GROUP BY lang""")
def duplicate_rate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified estimate of how many documents have a copy; the copies are counted over all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("k"))
    copies = docs.groupBy("k").agg((F.count("*") > 1).alias("dup"))
    sample = select.stratified(docs, ["lang"], F.col("doc_id"), 60, 4).join(copies, "k")
    return sample.groupBy("lang").agg(F.count("*").alias("sampled"), F.round(F.avg(F.col("dup").cast("double")), 6).alias("dup_rate"))


@query("SELECT c_nationkey, s, count(*) AS customers FROM (SELECT c_nationkey, floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) * 4 - 1)::double / count(*) OVER (PARTITION BY c_nationkey))::bigint AS s FROM customer) GROUP BY 1, 2")
def proportional_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards of each group with bounds total * i // 4."""
    c = select.ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], [F.col("c_custkey")], "r")
    c = c.withColumn("n", F.count("*").over(Window.partitionBy("c_nationkey")))
    return c.groupBy("c_nationkey", shard_of(F.col("r") - 1, F.col("n"), 4).alias("s")).agg(F.count("*").alias("customers"))

"""Building a corpus: cleaning, keys, labels, joins and deduplication over the synthetic tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import dedup, order, select
from ..sources.io import table
from .registry import query

SYNTHETIC_SQL = "CASE " + " ".join(
    f"WHEN {mine} = greatest({every}) AND greatest({every}) > 0 THEN '{name}'"
    for name, mine, every in (
        (n, " + ".join(f"contains(lower(text), '{p}')::int" for p in ps), ", ".join("(" + " + ".join(f"contains(lower(text), '{p}')::int" for p in qs) + ")" for qs in L.SYNTHETIC.values())) for n, ps in L.SYNTHETIC.items()
    )
) + " ELSE 'other' END"
#: Decomposition (NFKD) of the Latin letters and signs up to U+017F in SQL, which has no function for it.
DECOMPOSED_SQL = "text"
for _c in map(chr, range(0xA0, 0x180)):
    if (_d := unicodedata.normalize("NFKD", _c)) != _c:
        DECOMPOSED_SQL = f"replace({DECOMPOSED_SQL}, '{_c}', '{_d}')"
HASH_SQL = f"substr(sha1(trim(regexp_replace(lower({DECOMPOSED_SQL}), '\\s+', ' ', 'g'))), 1, 20)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.lower("text").alias("low"))
    return docs.withColumn("domain", L.classify(F.col("low"), L.SYNTHETIC, "other")).drop("low")


@query(f"""
WITH d AS (SELECT doc_id, source, {SYNTHETIC_SQL} AS domain, {HASH_SQL} AS key FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, doc_id) AS rn FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS place FROM w WHERE rn = 1)
SELECT domain, source, count(*) AS docs, min(doc_id) AS first_id FROM q WHERE place <= 300 GROUP BY ALL""")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicate by content key with source priority, label, cap each domain, count by domain and source."""
    docs = labelled(spark, sf_dir).withColumn("key", T.content_hash(F.col("text"))).drop("text", "lang")
    unique = dedup.first_per_key(docs, F.col("key"), [F.col("source"), F.col("doc_id")])
    return select.cap_per_group(unique, ["domain"], [F.col("doc_id")], 300).groupBy("domain", "source").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' +\\n', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS clean,
length(text) // 4 AS tokens FROM documents""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_whitespace(F.col("text")).alias("clean"), T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {HASH_SQL} AS key, sha256(text) AS sha, source || ':' || doc_id || ':' || substr(sha256(text), 1, 12) AS composite FROM documents")
def text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("key"), sha.alias("sha"), F.concat_ws(":", "source", "doc_id", F.substring(sha, 1, 12)).alias("composite"))


@query("""WITH a AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / greatest(length(text), 1) AS share FROM documents)
SELECT doc_id, round(share, 6) AS share, n >= 200 AND share >= 0.35 AS kept FROM a""")
def alpha_ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.alpha_share(text), 6).alias("share"), T.clean_enough(text).alias("kept"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS plain FROM pages""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), T.strip_html(F.col("html")).alias("plain"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN place > 400 THEN substr(cut, 1, place) ELSE cut END AS head
FROM (SELECT doc_id, text, substr(text, 1, 500) AS cut, CASE WHEN instr(reverse(substr(text, 1, 500)), chr(10)) > 0 THEN length(substr(text, 1, 500)) - instr(reverse(substr(text, 1, 500)), chr(10)) ELSE -1 END AS place FROM documents)""")
def truncate_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_at_newline(F.col("text"), 500).alias("head"))


@query(f"SELECT doc_id, {SYNTHETIC_SQL} AS domain FROM documents")
def domain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", "domain")


@query("""SELECT doc_id, name AS domain FROM documents, (VALUES ('alpha', 'tion'), ('beta', 'eau'), ('gamma', 'sch'), ('delta', 'ado')) v(name, stem)
WHERE text ILIKE '%' || stem || '%' AND length(text) BETWEEN 200 AND 4000""")
def domain_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under every domain whose pattern it matches: one scan, not one for each domain."""
    stems = {"alpha": ["tion"], "beta": ["eau"], "gamma": ["sch"], "delta": ["ado"]}
    found = F.array_compact(F.array(*[F.when(L.matches_any(F.col("text"), p), n) for n, p in stems.items()]))
    return table(spark, sf_dir, "documents").where(F.length("text").between(200, 4000)).select("doc_id", F.explode(found).alias("domain"))


def _votes(marks) -> str:
    return " + ".join(f"(length(h) - length(replace(h, '{m}', ''))) / {len(m)}" for m in marks)


@query(f"SELECT doc_id, lang, CASE WHEN {_votes(T.SPANISH)} > 1.5 * ({_votes(T.ENGLISH)}) THEN 'es' ELSE 'en' END AS vote FROM (SELECT doc_id, lang, lower(text) AS h FROM documents)")
def lang_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.language_vote(F.col("text")).alias("vote"))


_CODE = "CASE WHEN regexp_matches({0}, '\\b(CC0|CC BY)') THEN regexp_extract({0}, '\\b(CC0|CC BY(?:-(?:NC|ND|SA))*)', 1) WHEN regexp_matches({0}, '\\bMIT License') THEN 'MIT' WHEN contains({0}, 'Apache License') THEN 'Apache-2.0' WHEN regexp_matches({0}, 'GNU General Public License|\\bGPL') THEN 'GPL' WHEN regexp_matches({0}, '(?i)public domain') THEN 'public domain' END"
_CLASS = "CASE WHEN code IS NULL THEN 'unknown' WHEN regexp_matches(lower(code), 'nc|nd') THEN 'train' WHEN regexp_matches(lower(code), 'cc0|cc[- ]?by|public domain|mit|apache') THEN 'open' ELSE 'unknown' END"


@query(f"SELECT source, {_CLASS} AS class, count(*) AS docs FROM (SELECT source, {_CODE.format('text')} AS code FROM documents) GROUP BY 1, 2")
def license_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source by the class of the licence that their texts name."""
    return table(spark, sf_dir, "documents").groupBy("source", L.license_class(L.license_code(F.col("text"))).alias("class")).agg(F.count("*").alias("docs"))


@query(f"""WITH l AS (SELECT page_id, try_cast(nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') AS bigint) AS article, {_CODE.format('html')} AS code FROM pages), p AS (SELECT page_id, code FROM l WHERE code IS NOT NULL),
a AS (SELECT article, min_by(code, page_id) AS code FROM l WHERE code IS NOT NULL AND article IS NOT NULL GROUP BY article)
SELECT source, {_CLASS} AS class, count(*) AS docs FROM (SELECT source, CASE WHEN source < 'src15' THEN p.code ELSE a.code END AS code FROM documents d LEFT JOIN p ON p.page_id = d.doc_id LEFT JOIN a ON a.article = d.doc_id) GROUP BY 1, 2""")
def provenance_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence classes from a table with two keys: some sources look up the page's id, the others the article number in its address."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)(?:[?#]|$)", 1).try_cast("long").alias("article"), L.license_code(F.col("html")).alias("code")).where("code is not null")
    by_page = pages.select(F.col("page_id").alias("doc_id"), F.col("code").alias("c1"))
    by_article = pages.where("article is not null").groupBy(F.col("article").alias("doc_id")).agg(F.min_by("code", "page_id").alias("c2"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(by_page, "doc_id", "left").join(by_article, "doc_id", "left")
    return docs.groupBy("source", L.license_class(F.when(F.col("source") < "src15", F.col("c1")).otherwise(F.col("c2"))).alias("class")).agg(F.count("*").alias("docs"))


@query("SELECT source, count(*) AS n, sum(length(text) // 4)::bigint AS tokens FROM documents WHERE source IN ('src0', 'src3', 'src7') AND NOT (lang = 'es' OR source LIKE 'src1%') GROUP BY source")
def domain_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "documents").where(F.col("source").isin("src0", "src3", "src7") & ~((F.col("lang") == "es") | F.col("source").like("src1%")))
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query("""SELECT d.doc_id, d.source, 'labelled' AS part FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT d.doc_id, d.source, 'free' FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id""")
def anti_join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi").withColumn("part", F.lit("labelled")).unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("part", F.lit("free")))


@query("""SELECT o.o_orderkey, c.c_name, n.n_name, coalesce(r.r_name, 'none') AS region FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def crosswalk_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids translated over several tables in one pass of joins; Spark broadcasts those that are small by their statistics."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    out = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return out.select("o_orderkey", "c_name", "n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("SELECT c_mktsegment, count(*) AS customers, count(*) FILTER (has) AS with_orders FROM (SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer) GROUP BY 1")
def semi_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(True).alias("has")).distinct()
    c = table(spark, sf_dir, "customer").join(with_orders, F.col("c_custkey") == F.col("k"), "left")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count("has").alias("with_orders"))


@query("SELECT d.doc_id, l.quality, l.toxic, coalesce(l.quality, -1)::int AS shown FROM documents d LEFT JOIN labels l USING (doc_id)")
def labels_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return out.select("doc_id", "quality", "toxic", F.coalesce("quality", F.lit(-1)).alias("shown"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_docs, l.doc_id IS NOT NULL AS in_labels FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def full_outer_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("d"))
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l"))
    return d.join(l, "doc_id", "full_outer").select("doc_id", F.col("d").isNotNull().alias("in_docs"), F.col("l").isNotNull().alias("in_labels"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id")
def as_of_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("ts <= timestamp_ntz'2024-01-15'")
    return e.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY source DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("key"))
    return dedup.first_per_key(docs, F.col("key"), [F.col("source").desc(), F.col("doc_id")]).select("doc_id", "source")


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {HASH_SQL} AS key FROM documents) GROUP BY key")
def dedup_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("""WITH k AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN md5(text) END AS key FROM documents)
SELECT doc_id FROM k WHERE key IS NULL UNION ALL SELECT min(doc_id) FROM k WHERE key IS NOT NULL GROUP BY key""")
def dedup_keep_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "en", F.md5("text")).alias("key"))
    return dedup.first_per_key(docs, F.col("key"), [F.col("doc_id")], keep_keyless=True).select("doc_id")


@query("SELECT group_size, count(*) AS groups FROM (SELECT count(*) AS group_size FROM documents GROUP BY md5(text)) GROUP BY 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_counts(table(spark, sf_dir, "documents"), F.md5("text"))


@query("""WITH a AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE source < 'src15'), b AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE source >= 'src15')
SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_left, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_right""")
def containment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("k")).agg(F.max(F.col("source") < "src15").alias("a"), F.max(F.col("source") >= "src15").alias("b"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return sides.agg(n(F.col("a")).alias("left_rows"), n(F.col("b")).alias("right_rows"), n(F.col("a") & ~F.col("b")).alias("only_left"), n(F.col("b") & ~F.col("a")).alias("only_right"))


_FOLD = f"translate(lower(title), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}')"
_FLAT = "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
_KB = "CASE " + " ".join(f"WHEN bytes >= {1 << s} THEN format('{{:.1f}} {u}', round(bytes / {1 << s}, 1))" for u, s in (("GB", 30), ("MB", 20), ("KB", 10))) + " ELSE format('{} B', bytes) END"


@query(f"""WITH d AS (SELECT doc_id, source, text, strlen(text) AS bytes, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body, {_FLAT} AS flat FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(title || chr(10) || body, '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '')) AS joined_md5, {_FOLD} AS folded, substr(regexp_replace(regexp_replace({_FOLD}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug,
trim(regexp_replace(lower(title), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS question_key, CASE WHEN length(flat) <= 80 THEN flat WHEN contains(flat[:80], ' ') THEN regexp_replace(flat[:80], ' [^ ]*$', '') ELSE flat[:80] END AS cut, {_KB} AS size,
try_cast(nullif(regexp_extract(text, '((?:19|20)[0-9]{{2}})', 1), '') AS int) AS year, coalesce(len(list_filter(list_transform(string_split(title, ','), lambda x: trim(x, ' ')), lambda x: x <> '')), 0)::int AS parts,
CASE WHEN doc_id = 0 THEN 'h:' || {HASH_SQL} ELSE 'pmid:' || doc_id END AS canonical, upper(trim(source, ' ')) AS dedup, regexp_replace(regexp_replace(replace(regexp_extract(text, '[0-9][0-9.,]*', 0), ',', ''), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS number FROM d""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms, cuts and keys of every document; its first line is the title."""
    title = F.substring_index("text", "\n", 1)
    d = table(spark, sf_dir, "documents").withColumns({"title": title, "body": F.substring("text", F.length(title) + 2, F.length("text"))})
    title, text = F.col("title"), F.col("text")
    none = F.lit(None).cast("string")
    return d.select(
        "doc_id", F.md5(T.title_abstract(title, F.col("body"))).alias("joined_md5"), T.fold_accents(title).alias("folded"), T.slug(title, 60).alias("slug"), T.question_key(title).alias("question_key"), T.truncate_at_space(text, 80).alias("cut"), T.human_size(F.octet_length(text)).alias("size"),
        T.year_of(text, F.lit("")).alias("year"), F.size(T.split_list(title, ",")).alias("parts"), T.canonical_key(none, F.col("doc_id").cast("string"), none, none, text).alias("canonical"), T.dedup_key(F.col("source"), F.col("lang")).alias("dedup"), T.number_form(F.regexp_extract(text, "[0-9][0-9.,]*", 0)).alias("number"),
    )


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderpriority FROM orders) SELECT (y // 10 * 10)::int AS decade, coalesce(try_cast(split_part(o_orderpriority, '-', 1) AS int), 1900) AS level, count(*) AS n, row_number() OVER (ORDER BY y // 10 * 10 DESC, coalesce(try_cast(split_part(o_orderpriority, '-', 1) AS int), 1900)) AS place FROM o GROUP BY y // 10 * 10, 2""")
def decade_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by decade, latest first, and by the number that their priority begins with."""
    rows = table(spark, sf_dir, "orders").groupBy(T.decade(F.year("o_orderdate")).alias("decade"), T.safe_year(F.substring_index("o_orderpriority", "-", 1)).alias("level")).agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("decade").desc(), "level")))  # a row for each decade and level


@query("""WITH w AS (SELECT source, lower(unnest(regexp_extract_all(text, '[\\p{L}]{4,}'))) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL)
SELECT source, word, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS r FROM c) WHERE r <= 5""")
def most_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most common longer words of each source, a report: counts are combined in tasks and ranks limited before the exchange."""
    words = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[\\p{L}]{4,}"), F.lit(0))).alias("w"))
    counts = words.groupBy("source", F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    return select.ranked(counts, ["source"], [F.col("n").desc(), F.col("word")], "rank").where("rank <= 5")


@query("""WITH b AS (SELECT DISTINCT md5(array_to_string(w[i:i+7], ' ')) AS h FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 8)),
d AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 8))
SELECT doc_id, count(*) AS shared FROM d SEMI JOIN b USING (h) GROUP BY doc_id""")
def ngram_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.shared_ngrams(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), doc_id="doc_id", doc_text="text", ref_text="text")


@query("SELECT doc_id, source FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src1') AND source <> 'src1'")
def contamination_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("c"))
    return docs.where("source <> 'src1'").join(docs.where("source = 'src1'").select("c"), "c", "left_semi").select("doc_id", "source")


@query("""SELECT doc_id, i AS chunk, substr(text, i * 3000 + 1, 3000) AS body FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 2999) // 3000)) AS i FROM documents)
WHERE length(substr(text, i * 3000 + 1, 3000)) >= 600""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.floor((F.length("text") - 1) / 3000)
    rows = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return rows.select("doc_id", "chunk", F.substring("text", (F.col("chunk") * 3000 + 1).cast("int"), F.lit(3000)).alias("body")).where(F.length("body") >= 600)


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w)
SELECT doc_id, n AS words, round(len(list_distinct(g)) / greatest(len(g), 1), 6) AS share, n >= 15 AND len(list_distinct(g)) / greatest(len(g), 1) < 0.25 AS repetitive FROM p""")
def repetition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.word_list(F.col("text")).alias("w"))
    pairs = words.select("doc_id", F.size("w").cast("long").alias("words"), T.ngrams(F.col("w"), 2).alias("g"))
    share = F.size(F.array_distinct("g")) / F.greatest(F.size("g"), F.lit(1))
    return pairs.select("doc_id", "words", F.round(share, 6).alias("share"), ((F.col("words") >= 15) & (share < 0.25)).alias("repetitive"))


@query("SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS in_source, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents")
def rank_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and sizes of groups of any size: ranks are distributed running counts, sizes are counted and joined back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    placed = order.running_total(docs, [F.col("n").desc(), F.col("doc_id")], F.lit(1), "place", by=["source"])
    sizes = docs.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("in_source"))
    return placed.join(sizes, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "in_source", (F.col("place") + 1).cast("int").alias("rank"))

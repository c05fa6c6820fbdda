"""Neighbour lists, taxonomies, holdouts, joins on several keys, blocks in noisy text, rebinding and curve verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brackets, taxonomy
from ..operators import curves, holdout, matching, neighbours, rebinding
from ..sources.io import table
from .analysis import vectors
from .registry import query


@query()
def approximate_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen nearest of all vectors for every twentieth id, by inverted lists."""
    v = vectors(spark, sf_dir)
    return neighbours.approximate_top_k(v.where("id % 20 = 0"), v, 16).select("src", "dst", F.round("sim", 6).alias("sim"), "rank")


# Lexicons by a rule: all pairs of these syllables, dealt to forty labels in turn; three labels lead, as marks serve whole syllables.
_SYLLABLES = ["th", "er", "on", "an", "ch", "ent", "ion", "eau", "ung", "ado", "que", "lich", "ment"]
_STEMS = [a + b for a in _SYLLABLES for b in _SYLLABLES]
_LEADING = {f"field_{i:02}": _STEMS[i::40] for i in range(19)}
_OTHER = {f"field_{i:02}": _STEMS[i::40] for i in range(19, 40)}
_MARKS = ["tion", "ung", "eau", "ment", "dad", "heit"]


def _taxonomy_sql() -> str:
    hits = lambda t, stems: "(" + " + ".join(f"contains({t}, '{s}')::int" for s in stems) + ")"

    def label(name: str, t: str) -> str:
        lists = {k: "[" + ", ".join(hits(t, v) for v in group.values()) + "]" for k, group in (("a", _LEADING), ("b", _OTHER))}
        names = {k: "[" + ", ".join(f"'{n}'" for n in group) + "]" for k, group in (("a", _LEADING), ("b", _OTHER))}
        best = {k: f"{names[k]}[list_position({k}, list_max({k}))]" for k in "ab"}
        return f"""SELECT doc_id, CASE WHEN list_max(a) >= 2 AND (list_max(a) >= list_max(b) OR m < 3) THEN {best["a"]} WHEN list_max(b) >= 1 THEN {best["b"]} WHEN list_max(a) >= 1 THEN {best["a"]} ELSE 'other' END AS {name}
FROM (SELECT doc_id, {lists["a"]} AS a, {lists["b"]} AS b, {hits(t, _MARKS)} AS m FROM d)"""

    return f"""WITH d AS MATERIALIZED (SELECT doc_id, lower(text) AS t, lower(title) AS h, title, text, source FROM (SELECT *, CASE WHEN contains(text, chr(10)) THEN trim(split_part(text, chr(10), 1), ' ') END AS title FROM documents)),
x AS ({label("by_title", "h")}), y AS ({label("by_text", "t")})
SELECT doc_id, CASE WHEN title <> '' THEN by_title WHEN text <> '' THEN by_text ELSE source END AS label, CASE WHEN title <> '' THEN 'title' WHEN text <> '' THEN 'text' ELSE 'coarse' END AS label_source FROM d JOIN x USING (doc_id) JOIN y USING (doc_id)"""


@query(_taxonomy_sql())
def taxonomy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label out of forty by the title (the first of several lines), else by the text, else the source."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.withColumn("title", F.when(F.contains("text", F.lit("\n")), F.trim(F.substring_index("text", "\n", 1))))
    lists = taxonomy.lexicon_lists(_LEADING, _OTHER, _MARKS)
    rows = rows.withColumns({f"__{c}": taxonomy.lexicon_hits(F.col(c), lists) for c in ("title", "text")})
    label, source = taxonomy.cascade({c: taxonomy.fine_label(F.col(f"__{c}"), list(_LEADING), list(_OTHER)) for c in ("title", "text")}, {c: F.col(c) for c in ("title", "text")}, F.col("source"))
    return rows.select("doc_id", label.alias("label"), source.alias("label_source"))


_GRAMS = "SELECT {0} AS id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT {0}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {1}) WHERE len(w) >= 8"


@query(f"""WITH RECURSIVE b AS ({_GRAMS.format("item_id", "benchmark")}), d AS ({_GRAMS.format("doc_id", "documents")}),
l AS MATERIALIZED (SELECT DISTINCT b.id AS item, d.id AS doc FROM b JOIN d USING (g)), reach(item, other) AS (SELECT item_id, item_id FROM benchmark UNION SELECT r.item, y.item FROM reach r JOIN l x ON x.item = r.other JOIN l y ON y.doc = x.doc)
SELECT reach.item AS item_id, min(other) AS "group", coalesce(bool_or(doc % 10 <> 0), false) AS leaked FROM reach LEFT JOIN l ON l.item = reach.other GROUP BY 1""")
def holdout_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items by groups that share passages with documents; all but every tenth document is in training."""
    return holdout.clean_holdout(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), F.col("doc_id") % 10 != 0, item="item_id", item_text="text", doc="doc_id", doc_text="text")


_KEYS = "doc_id, source, md5(text) AS k1, CASE WHEN contains(text, chr(10)) THEN nullif(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g'), ' '), '') END AS k2"


@query(f"""WITH l AS (SELECT {_KEYS} FROM documents WHERE doc_id % 2 = 1), r AS (SELECT {_KEYS} FROM documents WHERE doc_id % 2 = 0),
m AS (SELECT l.doc_id, 1 AS n, r.doc_id AS partner, r.source FROM l JOIN r ON l.k1 = r.k1 UNION ALL SELECT l.doc_id, 2, r.doc_id, r.source FROM l JOIN r ON l.k2 = r.k2),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, partner) AS i FROM m)
SELECT l.doc_id, b.n AS matched_by, b.partner, b.source AS partner_source FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND b.i = 1""")
def key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents with their first partner among the even ones: by equal text, else by the normal form of the title line."""
    title = F.when(F.contains("text", F.lit("\n")), F.trim(F.regexp_replace(F.lower(F.substring_index("text", "\n", 1)), "[^a-z0-9]+", " ")))
    docs = table(spark, sf_dir, "documents")
    right = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("partner"), F.col("source").alias("partner_source"), "text")
    keys = [F.md5("text"), title]
    return matching.first_match(docs.where("doc_id % 2 = 1").select("doc_id", "text"), right, "doc_id", keys, keys, ["partner"], ["partner", "partner_source"]).drop("text")


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost bracketed blocks of each page's source (style rules, script objects), in order."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(brackets.top_blocks(F.col("html"))).alias("place", "block"))
    return pages.select("page_id", "place", F.length("block").alias("chars"), F.md5("block").alias("block_md5"))


_KINDS = {"name": "[A-Z][a-z]{3,} [a-z]{4,}", "number": "[0-9]+(?:[.][0-9]+)?"}


@query(f"""WITH s AS MATERIALIZED (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), '([.!?]) ([A-Z0-9{{\\\\\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM documents),
u AS (SELECT doc_id, i - 1 AS sentence, parts[i] AS body FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM s) WHERE parts[i] <> ''),
f AS (SELECT doc_id, sentence, kind, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS place FROM (SELECT doc_id, sentence, 'name' AS kind, regexp_extract_all(body, '{_KINDS["name"]}') AS v FROM u UNION ALL SELECT doc_id, sentence, 'number', regexp_extract_all(body, '{_KINDS["number"]}') FROM u)),
n AS (SELECT value FROM f WHERE kind = 'name' GROUP BY value HAVING count(DISTINCT doc_id) >= 3), m AS MATERIALIZED (SELECT * FROM f WHERE kind = 'number' OR value IN (SELECT value FROM n)),
h AS (SELECT doc_id, kind, sentence, list(value) AS here FROM m GROUP BY ALL),
o AS (SELECT a.doc_id, a.kind, a.sentence, a.place, a.value AS old, max_by(b.value, [b.sentence, b.place]) AS new FROM m a JOIN h USING (doc_id, kind, sentence) JOIN m b ON b.doc_id = a.doc_id AND b.kind = a.kind AND b.sentence < a.sentence AND NOT list_contains(here, b.value) GROUP BY ALL),
w AS (SELECT doc_id, kind, max_by({{'sentence': sentence, 'old': old, 'new': new}}, [sentence, place]) AS o FROM o GROUP BY ALL)
SELECT w.doc_id, kind, o.sentence::int AS sentence, o.old AS old, o.new AS new, body[:strpos(body, o.old) - 1] || o.new || substr(body, strpos(body, o.old) + length(o.old)) AS mutated FROM w JOIN u ON u.doc_id = w.doc_id AND u.sentence = o.sentence""")
def attested_rebinding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences whose last name or number is exchanged for one that the same document has before."""
    return rebinding.rebound(table(spark, sf_dir, "documents").select("doc_id", "text"), _KINDS, {"number"})


_CURVE = "SELECT user_id AS run, date_diff('day', DATE '2024-01-01', ts::date) AS step, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS acc, 40 + count(*) AS n FROM events GROUP BY ALL"


@query(f"""WITH c AS MATERIALIZED ({_CURVE}), k AS (SELECT *, round(acc * n)::bigint AS wins FROM c), f AS (SELECT i, sum(CASE WHEN i = 0 THEN 0 ELSE ln(i) END) OVER (ORDER BY i) AS lf FROM range(0, (SELECT max(n) + 1 FROM c)::bigint) r(i)),
t AS (SELECT run, step, n, unnest(range(wins, n + 1)) AS i FROM k), q AS (SELECT run, step, least(1, sum(exp(a.lf - b.lf - c.lf + n * ln(0.5)))) AS p FROM t JOIN f a ON a.i = n JOIN f b ON b.i = t.i JOIN f c ON c.i = n - t.i GROUP BY ALL),
z AS MATERIALIZED (SELECT k.*, p, count(*) OVER (PARTITION BY run) AS looks, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS back FROM k JOIN q USING (run, step)),
g AS (SELECT run, max(looks) AS looks, max(step) AS final_step, max_by(acc, step) AS final_acc, max_by(wins, step) AS wins, max_by(p, step) AS p, max(acc) AS peak, min_by(p, [-acc, step]) AS single,
CASE WHEN count(*) FILTER (back <= 3) = 3 THEN regr_slope(acc, step) FILTER (back <= 3) END AS slope, min(step) FILTER (p < 0.05 / looks) AS decided_step FROM z GROUP BY run)
SELECT run, looks, final_step::int AS final_step, round(final_acc, 6) AS final_acc, wins, round(p, 6) AS p, round(slope, 6) AS slope, CASE WHEN final_acc >= 0.6 AND p < 0.05 THEN 'HIT' WHEN final_acc > 0.535 AND coalesce(slope, 0) > 0 AND p < 0.05 THEN 'EXTEND' WHEN final_acc <= 0.55 AND p >= 0.05 THEN 'FALSIFY' ELSE 'NO-GO' END AS verdict,
round(peak, 6) AS peak, round(1 - (1 - single) ** looks, 6) AS p_peak, decided_step::int AS decided_step,
CASE WHEN looks < 3 THEN 'INSUFFICIENT' WHEN final_acc >= 0.6 THEN 'HIT' WHEN final_acc <= 0.55 AND final_acc < 0.535 THEN 'FALSIFY' WHEN final_acc > 0.535 AND final_acc < 0.6 AND slope > 0 THEN 'EXTEND' ELSE 'NO-GO' END AS trend FROM g""")
def curve_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days as the looks at a run: the share of large values, with the verdicts of both rules."""
    e = table(spark, sf_dir, "events")
    points = e.groupBy(F.col("user_id").alias("run"), F.date_diff("ts", F.lit("2024-01-01").cast("date")).alias("step")).agg(F.avg((F.col("value") > 50).cast("double")).alias("acc"), (F.count("*") + 40).alias("n"))
    out = curves.curve_verdicts(points, go=0.55, hit=0.6, ref=0.535)
    trend = curves.trend_verdict(F.col("looks"), F.col("final_acc"), F.col("slope"))
    rounded = {c: F.round(c, 6) for c in ("final_acc", "p", "slope", "peak", "p_peak")}
    return out.withColumn("trend", trend).withColumns(rounded)

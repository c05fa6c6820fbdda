"""Dialogues, groundedness, structure, pairs, tool calls and token sequences over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import skeleton as K
from ..functions import structure as S
from ..functions import text as T
from ..operators import pairs, select, tokens
from ..sources.io import table
from .registry import query


@query("""SELECT conv_id, turn, '[USER] ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10) || '[ASSISTANT]' AS prompt, ' ' || trim(regexp_replace(reply, '\\s+', ' ', 'g')) AS response
FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exchanges(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, prompt FROM (SELECT conv_id, text AS prompt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r
FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE role = 'user' AND next_role = 'assistant') WHERE r = 1""")
def first_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    found = c.where("role = 'user' and next_role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    return found


@query("SELECT conv_id, string_agg('[' || upper(role) || '] ' || text, chr(10) ORDER BY turn) AS body, count(*) AS turns FROM conversations GROUP BY conv_id")
def serialize_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.serialise_turns(table(spark, sf_dir, "conversations"))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-záéíóúñü][a-záéíóúñü\\-'']*'), lambda w: length(w) > 3 AND NOT list_contains(" + _STOP_SQL + ", w))"
_NUMS = "list_transform(regexp_extract_all({0}, '\\d[\\d.,]*'), lambda n: regexp_replace(regexp_replace(replace(n, ',', ''), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''))"
_GROUND = f"""WITH p AS (SELECT conv_id, turn, text AS q, lead(role) OVER w AS r2, lead(text) OVER w AS a, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, q, a, {_WORDS.format('a')} AS aw, {_WORDS.format('q')} AS qw, {_NUMS.format('a')} AS an, {_NUMS.format('q')} AS qn FROM p WHERE role = 'user' AND r2 = 'assistant'),
g AS (SELECT *, CASE WHEN len(aw) = 0 THEN 0.0 ELSE len(list_filter(aw, lambda w: list_contains(qw, w)))::double / len(aw) END AS recall, len(list_filter(an, lambda n: NOT list_contains(qn, n))) = 0 AS nums FROM s)"""


@query(_GROUND + " SELECT conv_id, turn, round(recall, 6) AS recall, nums, CASE WHEN length(q) > 400 OR length(a) NOT BETWEEN 10 AND 2000 THEN 'length' WHEN recall < 0.05 THEN 'recall' WHEN NOT nums THEN 'numbers' ELSE 'kept' END AS outcome FROM g")
def grounded_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by their support in the question, with the first reason to reject."""
    return S.grounded(S.turn_pairs(table(spark, sf_dir, "conversations")), 0.05).select("conv_id", "turn", F.round("recall", 6).alias("recall"), "nums", "outcome")


@query(_GROUND + """ SELECT conv_id, count(*) AS answers, round(avg(recall), 6) AS recall, round(avg(CASE WHEN len(an) > 0 THEN nums::int END), 6)::double AS numbers_agree, count(*) FILTER (len(an) > 0) AS with_numbers FROM g GROUP BY conv_id""")
def answer_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's user turns as answers to what the assistant says next: share of its content words, and of its numbers where it has any."""
    rows = S.turn_pairs(table(spark, sf_dir, "conversations")).withColumn("agree", F.when(F.size(T.numbers(F.col("a"))) > 0, T.numbers_supported(F.col("a"), F.col("q")).cast("int")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("answers"), F.round(F.avg(T.recall(F.col("a"), F.col("q"))), 6).alias("recall"), F.round(F.avg("agree"), 6).alias("numbers_agree"), F.count("agree").alias("with_numbers"))


@query(_GROUND + """, r AS (SELECT *, sum(CASE WHEN length(q) <= 400 AND length(a) BETWEEN 10 AND 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bad FROM g),
k AS (SELECT conv_id, count(*) AS turns, min_by(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')), turn) AS key FROM r WHERE bad = 0 GROUP BY conv_id HAVING count(*) >= 2)
SELECT conv_id, turns FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY conv_id) AS n FROM k) WHERE n = 1""")
def multi_turn_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.grounded(S.turn_pairs(table(spark, sf_dir, "conversations")), 0.05)
    good = select.valid_prefix(pairs, ["conv_id"], [F.col("turn")], F.col("outcome") != "length", least=2)
    runs = good.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by(T.question_key(F.col("q")), "turn").alias("key"))
    return select.ranked(runs, ["key"], [F.col("conv_id")], "n").where("n = 1").select("conv_id", "turns")


@query("""SELECT doc_id, i AS place, p AS paragraph, length(p) - length(replace(p, ' ', '')) + 1 AS words FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: len(regexp_split_to_array(x, ' ')) BETWEEN 30 AND 400 AND length(regexp_replace(x, '[^\\p{L}]', '', 'g')) / greatest(length(x), 1) >= 0.55) AS ps FROM documents))""")
def paragraph_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.paragraphs(F.col("text"))).alias("i", "paragraph"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("place"), "paragraph", (F.length("paragraph") - F.length(F.replace("paragraph", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"))


@query()
def paragraph_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.passages(table(spark, sf_dir, "documents"), least_score=0.0, least_words=120)


@query("""SELECT doc_id, count(*) AS sentences, max(length(s))::int AS longest FROM (SELECT doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), '([.!?]) ([A-Z0-9{\\\\\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS s FROM documents) WHERE s <> '' GROUP BY doc_id""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.sentences(F.col("text"))).alias("place", "sentence"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("sentence")).alias("longest"))


@query("""WITH t AS (SELECT doc_id, '[OBS] ' || translate(text, '[]', '()') || ' [EVID] ' || source || ' [CONC] ' || lang AS tagged FROM documents)
SELECT doc_id, trim(regexp_extract(tagged, '(?s)\\[OBS\\](.*?)(\\[|$)', 1)) AS obs, trim(regexp_extract(tagged, '(?s)\\[EVID\\](.*?)(\\[|$)', 1)) AS evid, trim(regexp_extract(tagged, '(?s)\\[CONC\\](.*?)(\\[|$)', 1)) AS conc FROM t""")
def stage_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.translate("text", "[]", "()")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[OBS] "), body, F.lit(" [EVID] "), "source", F.lit(" [CONC] "), "lang").alias("tagged"))
    stages = S.tagged_stages(F.col("tagged"))
    return docs.select("doc_id", *[F.trim(F.element_at(stages, n)).alias(n.lower()) for n in ("OBS", "EVID", "CONC")])


def _skeleton_sql() -> str:
    """Skeletons by string lists: marks are put in, split at, and looked up by stage."""
    none = "[NULL, NULL, NULL, NULL, NULL]::varchar[]"
    words = lambda xs: ", ".join(f"'{x}'" for x in xs)
    label_stage = " ".join(f"WHEN lower(string_split(p, chr(2))[1]) IN ({words(v)}) THEN '{k}'" for k, v in K.LABELLED.items())
    head_stage = " ".join(f"WHEN {' OR '.join(f"starts_with(lower(x), '{b}')" for b in v)} THEN '{k}'" for k, v in K.HEADED.items())
    pick = lambda xs: "[" + ", ".join(f"list_filter({xs}, lambda f: f.stage = '{s}')[1].body" for s in K.ORDER) + "]"
    phrase = lambda s: f"list_filter(parts, lambda x, i: i - 1 {'>=' if s in ('EVID', 'CONC') else '<='} greatest(1, len(parts) // 3) AND length(x) > 45 AND regexp_matches(lower(x), '{K.PHRASES[s]}'))[1][:400]" if s in K.PHRASES else "NULL"
    some = lambda c: f"len(list_filter({c}, lambda s: s IS NOT NULL))"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS flat FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(flat, '{K.LABEL}', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:] AS labels,
string_split(array_to_string(list_filter(list_transform(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: CASE WHEN length(x) < 90 AND regexp_matches(x, '{K.HEADING}') THEN chr(1) || (CASE {head_stage} ELSE '' END) || chr(2) ELSE x END), lambda x: x <> ''), ' '), chr(1))[2:] AS heads,
list_filter(string_split(regexp_replace(flat, '([.!?]) ([A-Z0-9{{\\\\\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: s <> '') AS parts FROM t),
f AS (SELECT doc_id, parts, list_filter(list_transform(labels, lambda p, i: {{'stage': CASE {label_stage} END, 'body': trim(string_split(p, chr(2))[2], ' :')[:900], 'last': i = len(labels)}}), lambda f: length(f.body) >= 20 OR f.last) AS l, len(labels) AS n,
list_filter(list_transform(heads, lambda p: {{'stage': string_split(p, chr(2))[1], 'body': trim(string_split(p, chr(2))[2], ' ')[:1500]}}), lambda f: length(f.body) > 120) AS h FROM p),
s AS (SELECT doc_id, parts, CASE WHEN n >= 2 THEN {pick("l")} ELSE {none} END AS a, {pick("h")} AS b, [{", ".join(map(phrase, K.ORDER))}]::varchar[] AS c FROM f),
m AS (SELECT *, CASE WHEN {some("a")} < 3 THEN list_transform(a, lambda x, i: coalesce(b[i], x)) ELSE a END AS two FROM s),
r AS (SELECT *, list_transform(CASE WHEN {some("two")} < 3 THEN list_transform(two, lambda x, i: coalesce(x, c[i])) ELSE two END, lambda x, i: CASE WHEN i = 1 THEN coalesce(x, list_filter(parts[:4], lambda s: length(s) > 40)[1][:200]) ELSE x END) AS st FROM m)
SELECT doc_id, CASE WHEN {some("a")} < 3 AND {some("b")} >= 2 THEN 'headings' WHEN {some("a")} > 0 THEN 'labels' WHEN {some("two")} < 3 AND {some("c")} > 0 THEN 'phrases' ELSE 'none' END AS strategy, {some("st")}::int AS stages,
nullif(array_to_string(list_filter(list_transform(st, lambda x, i: CASE WHEN x <> '' THEN '[' || [{words(K.ORDER)}][i] || '] ' || trim(x, ' ') END), lambda x: x IS NOT NULL), chr(10)), '') AS skeleton FROM r"""


@query(_skeleton_sql())
def skeleton_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.skeletons(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "strategy", "stages", "skeleton")


@query(f"""WITH k AS ({_skeleton_sql()}) SELECT lang, strategy, count(*) AS docs, round(avg(CASE WHEN stages >= 2 THEN 1.0 ELSE 0.0 END), 6)::double AS two_or_more, round(avg(CASE WHEN stages >= 3 THEN 1.0 ELSE 0.0 END), 6)::double AS three_or_more,
count(*) FILTER (stages = 0) AS none, count(*) FILTER (stages = 1) AS one FROM k JOIN documents USING (doc_id) GROUP BY 1, 2""")
def skeleton_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies and coverage of skeletons by language."""
    rows = S.skeletons(table(spark, sf_dir, "documents").select("lang", "text"))
    share = lambda n: F.round(F.avg((F.col("stages") >= n).cast("double")), 6)
    return rows.groupBy("lang", "strategy").agg(F.count("*").alias("docs"), share(2).alias("two_or_more"), share(3).alias("three_or_more"), F.count_if(F.col("stages") == 0).alias("none"), F.count_if(F.col("stages") == 1).alias("one"))


@query("""SELECT event_id, json_extract_string(props, '$.page') AS page, try_cast(json_extract_string(props, '$.ref') AS bigint) AS ref, props IS NOT NULL AND json_valid(props) AS ok FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").try_cast("long").alias("ref"), (F.col("props").isNotNull() & F.try_parse_json("props").isNotNull()).alias("ok"))


@query("""WITH w AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':1')) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT a.doc_id, b.doc_id AS mate FROM w a JOIN w b ON a.source = b.source AND b.r = (a.r + 1) % a.n WHERE a.n > 1""")
def random_mate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another document of the same source for each, the next one in a random order."""
    return pairs.mates(table(spark, sf_dir, "documents"), ["source"], 1)


_IDS = "list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: length(x)::int)"


@query(f"""SELECT doc_id, i AS part, ids[i * 256 + 1 : i * 256 + 256] AS ids FROM (SELECT doc_id, {_IDS} AS ids, unnest(range(0, (len({_IDS}) + 255) // 256)) AS i FROM documents) WHERE len(ids[i * 256 + 1 : i * 256 + 256]) >= 4""")
def window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.windows(tokens.word_lengths(table(spark, sf_dir, "documents")), 256).select("doc_id", "part", "ids")


@query(f"SELECT doc_id, list_transform({_IDS}, lambda x: CASE WHEN x >= 10 THEN 0 ELSE x END) AS ids, coalesce(len(list_filter({_IDS}, lambda x: x >= 10)), 0)::int AS replaced FROM documents")
def oob_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.word_lengths(table(spark, sf_dir, "documents"))
    return ids.select("doc_id", tokens.in_vocabulary(F.col("ids"), 10).alias("ids"), F.size(F.filter("ids", lambda x: x >= 10)).alias("replaced"))


@query(f"""WITH d AS (SELECT doc_id, list_append({_IDS}, -1) AS ids, (row_number() OVER (ORDER BY md5(doc_id || ':8')) - 1) % 8 AS stream, row_number() OVER (ORDER BY md5(doc_id || ':8')) AS r FROM documents)
SELECT stream, count(*) AS docs, sum(len(ids))::bigint AS tokens, min_by(doc_id, r) AS first_doc FROM d GROUP BY stream""")
def pack_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = tokens.streams(tokens.word_lengths(table(spark, sf_dir, "documents")), 8, 8)
    return packed.groupBy("stream").agg(F.count("*").alias("docs"), F.sum(F.size("ids") + 1).alias("tokens"), F.min_by("doc_id", "rank").alias("first_doc"))


@query(f"""WITH d AS (SELECT doc_id, list_append({_IDS}, -1) AS ids, (row_number() OVER (ORDER BY md5(doc_id || ':8')) - 1) % 8 AS stream, row_number() OVER (ORDER BY md5(doc_id || ':8')) AS r FROM documents),
t AS (SELECT stream, id, row_number() OVER (PARTITION BY stream ORDER BY r, i) - 1 AS pos FROM (SELECT stream, r, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM d))
SELECT stream, block, ids || list_transform(range(128 - len(ids)), lambda x: -1) AS ids FROM (SELECT stream, pos // 128 AS block, list(id ORDER BY pos) AS ids FROM t GROUP BY ALL)""")
def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to eight streams in random order, as blocks of exactly 128 tokens."""
    return tokens.packed(tokens.word_lengths(table(spark, sf_dir, "documents")), 8, 128, -1, 8)


@query("""SELECT event_id, event_type IN ('click', 'view') AS valid, CASE WHEN event_type <> 'error' THEN event_type END AS function, CASE event_type WHEN 'error' THEN 'function' WHEN 'signup' THEN 'required' WHEN 'purchase' THEN 'type' ELSE 'ok' END AS reason, CASE WHEN event_id % 3 = 0 THEN 'braces' ELSE '' END AS repairs FROM events""")
def toolcall_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on each event's call by a table of functions, every third call without its last brace."""
    call = F.concat(F.lit('{"function": "'), "event_type", F.lit('", "args": '), "props", F.when(F.col("event_id") % 3 == 0, "").otherwise("}"))
    verdict = S.verify_calls({"click": ({"k": "integer"}, {}), "view": ({}, {"k": "number"}), "purchase": ({"k": "text"}, {}), "signup": ({"k": "number", "plan": "text"}, {})})
    return table(spark, sf_dir, "events").select("event_id", verdict(call).alias("v")).select("event_id", "v.*")


@query("""SELECT doc_id, regexp_matches(text, '  ') AS double_space, regexp_matches(text, '\\s[,.;:]') AS space_before, regexp_matches(text, '(?i)\\b(the the|a a|an an)\\b') AS doubled_article, regexp_matches(text, '(?i)\\ba [aeiou]') AS a_vowel, length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) AS unbalanced FROM documents""")
def fluency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fluency(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

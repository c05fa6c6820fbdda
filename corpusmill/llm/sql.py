"""DuckDB SQL for the queries of this subpackage that SQL can express.  The others are tested against brute force."""

WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, u.b FROM reach JOIN u ON reach.seen = u.a),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT c.node AS doc_id, coalesce(n, 0)::bigint AS n_shingles, component AS component_id, component = c.node AS kept FROM c LEFT JOIN n ON n.doc_id = c.node"""

#: CRC-32 of the decimal digits of conv_id, bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295)"

OP11 = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS w FROM t GROUP BY conv_id),
h AS (SELECT conv_id, w, {CRC} % 9 AS h FROM o),
c AS MATERIALIZED (SELECT h.conv_id, coalesce(b.w[1:h.h], []) || h.w[h.h + 1:] AS w FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS MATERIALIZED (SELECT conv_id, d, len(w) = d AS last, sha256(w[1:d]::varchar) AS k, CASE WHEN d > 0 THEN sha256(w[1:d - 1]::varchar) END AS p, CASE WHEN d > 0 THEN strlen(w[d].text) ELSE 0 END AS n_bytes FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM c)),
n AS MATERIALIZED (SELECT d, k, any_value(p) AS p, any_value(n_bytes) AS n_bytes, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN last THEN conv_id::varchar END, ',' ORDER BY conv_id), '') AS ends FROM m GROUP BY d, k),
kids AS (SELECT d - 1 AS d, p AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)),
s AS (SELECT m.d, m.k, sum((f.n_convs - 1) * f.n_bytes) AS saved, count(*) FILTER (f.n_children = 0) AS leaves FROM m JOIN f ON f.conv_id = m.conv_id AND f.d >= m.d GROUP BY ALL)
SELECT f.conv_id, f.d::bigint AS depth, q.conv_id AS parent_conv_id, f.n_convs::bigint AS n_convs, f.n_children::bigint AS n_children, s.leaves::bigint AS n_leaves, s.saved::bigint AS saved_tokens, sha256(f.ends) AS ends_sha256 FROM f JOIN s USING (d, k) LEFT JOIN f q ON q.d = f.d - 1 AND q.k = f.p"""


def op12(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds written out one after another."""

    def nearest(books: str) -> str:
        gap = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        return f"SELECT vec_id, p.part, min({{'gap': gap, 'entry': entry}}) AS best FROM (SELECT p.vec_id, p.part, b.entry, {gap} AS gap FROM p JOIN {books} b ON b.part = p.part) p GROUP BY ALL"

    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS x FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x FROM v, range({parts}) r(part))",
        f"e0 AS (SELECT part, n - 1 AS entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS n FROM p) WHERE n <= {entries})",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({nearest(f'e{r}')})",
            f"m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT part, best.entry AS entry, i, sum(x)::bigint AS s, count(*) AS n FROM (SELECT p.part, best, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM p JOIN a{r} USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL)",
            f"e{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, e{r}.c) AS c FROM e{r} LEFT JOIN m{r} USING (part, entry))",
        ]
    steps += [
        f"a{rounds} AS ({nearest(f'e{rounds}')})",
        f"d AS (SELECT vec_id, label, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, sum(best.gap)::bigint AS error FROM a{rounds} JOIN v USING (vec_id) GROUP BY ALL)",
        f"k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM d, k"


ORACLE_SQL = {"op1_substring_dedup": OP1, "op10_near_dedup": OP10, "op11_prefix_trie": OP11, "op12_vector_codes": op12()}

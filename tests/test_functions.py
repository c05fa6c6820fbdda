"""Expressions on small hand-made rows."""

import numpy as np
import pytest
from corpusmill.functions import labels as L
from corpusmill.functions import stats
from corpusmill.functions import skeleton as K
from corpusmill.functions import structure as S
from corpusmill.functions import text as T
from corpusmill.operators import dedup, select, similarity, tokens
from corpusmill.sources import io
from corpusmill.streaming import incremental
from pyspark.sql import functions as F


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(
    "make, text, want",
    [
        (T.clean_whitespace, "a  b \n\n\n\nc\t d  ", "a b\n\nc d"),
        (T.strip_html, "<p>a &lt;b&gt; &amp;amp;</p>", "a <b> &amp;"),
        (T.question_key, "  What IS\n it ", "what is it"),
        (T.number_form, "1,250.500", "1250.5"),
        (T.number_form, "100", "100"),
        (T.slug, "Árboles y Ñandúes!", "arboles-y-nandues"),
        (T.fold_accents, "Canción", "cancion"),
        (T.strip_latex, "a % x\n\\section{B} $x^2$ \\cite{k} \\begin{table}z\\end{table} c", "a \nB c"),
        (T.latex_body, "\\documentclass{x}\n\\begin{document}in $5$ kg", "in 5 kg"),
        (T.present, " none ", None),
        (T.language_vote, "x el perro de la casa que los ve ", "es"),
        (T.language_vote, "the cat of the house and a dog in it", "en"),
    ],
)
def test_text(spark, make, text, want):
    assert one(spark, make(F.col("t")), t=text) == want


def test_number_form_legacy(spark):
    assert one(spark, T.number_form(F.col("t"), legacy=True), t="100") == "1"


@pytest.mark.parametrize("row, want", [(("1", "2", "3", "4"), "pmc:1"), (("none", "2", "", ""), "pmid:2"), (("0", "null", "", "10.1/x"), "doi:10.1/x")])
def test_canonical_key(spark, row, want):
    cols = dict(zip("abcd", row, strict=True))
    assert one(spark, T.canonical_key(*[F.col(c) for c in "abcd"], F.lit("t")), **cols) == want


def test_truncation(spark):
    assert one(spark, T.truncate_at_newline(F.col("t"), 12), t="1234567890\n1234") == "1234567890"
    assert one(spark, T.truncate_at_newline(F.col("t"), 10), t="12\n4567890123") == "12\n4567890"
    assert one(spark, T.truncate_at_space(F.col("t"), 8), t="abc defg hij") == "abc"


def test_groundedness(spark):
    passage = "The forest holds 1,200 species across regions"
    assert one(spark, T.recall(F.lit("forest species vanish"), F.col("p")), p=passage) == pytest.approx(2 / 3)
    assert one(spark, T.numbers_supported(F.lit("1200 species"), F.col("p")), p=passage) is True
    assert one(spark, T.numbers_supported(F.lit("13 species"), F.col("p")), p=passage) is False


def test_domains(spark):
    assert one(spark, L.classify(F.col("t"), L.DOMAINS, "bioc"), t="soil nitrogen and sediment in rhizosphere") == "soil"
    assert one(spark, L.classify(F.col("t"), L.DOMAINS, "bioc"), t="nothing here") == "bioc"
    assert one(spark, L.classify(F.col("t"), {"a": ["x"], "b": ["y"]}, "z"), t="xy") == "a"


@pytest.mark.parametrize("code, want", [("CC BY 4.0", "open"), ("cc-by-nc", "train"), (None, "unknown"), ("odd", "unknown")])
def test_licenses(spark, code, want):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(L.license_class(F.col("c"))).first()[0] == want


def test_fine_label(spark):
    cols = {"e": 2, "b": 5, "g": 0, "c": 2}
    assert one(spark, L.fine_label(*[F.col(c) for c in "ebgc"]), **cols) == "eco"
    assert one(spark, L.fine_label(*[F.col(c) for c in "ebgc"]), **cols | {"c": 3}) == "biomedical"


@pytest.mark.parametrize("k, n, low, high", [(135, 256, 0.4662, 0.5876), (0, 10, 0.0, 0.2775)])
def test_wilson(spark, k, n, low, high):
    got = one(spark, stats.wilson(F.col("k"), F.col("n")), k=k, n=n)
    assert (round(got["low"], 4), round(got["high"], 4)) == (low, high)


@pytest.mark.parametrize("k, n", [(135, 256), (154, 256), (1, 3), (3, 3), (0, 5), (510, 1000)])
def test_binomial(spark, k, n):
    from math import comb

    exact = sum(comb(n, i) for i in range(k, n + 1)) / 2**n
    assert one(spark, stats.binomial_tail(F.col("k"), F.col("n")), k=k, n=n) == pytest.approx(exact, rel=1e-9)


def test_sample_size(spark):
    assert 600 <= one(spark, stats.sample_size(F.col("d")), d=0.05) <= 650


def test_curriculum(spark):
    stages = [(0, 16, 0.3), (2000, 32, 0.6), (5000, 64, 0.95)]
    for step, span, share in ((0, 16, 0.3), (2000, 32, 0.6), (5000, 64, 0.95), (10000, 64, 0.95)):
        got = one(spark, stats.curriculum(F.col("s"), stages), s=step)
        assert got["span"] == span and got["fraction"] == pytest.approx(share)


def test_tagged_stages(spark):
    got = one(spark, S.tagged_stages(F.col("t")), t="[OBS] seen\n[EVID]  \n[CONC] done [OBS] again")
    assert {k: v.strip() for k, v in got.items()} == {"OBS": "seen", "CONC": "done"}
    assert one(spark, S.serialise_stages(F.create_map(F.lit("CONC"), F.lit("c"), F.lit("OBS"), F.col("t"))), t="o") == "[OBS] o\n[CONC] c"


def plain_skeleton(text):
    """Stages of a text by loops: labels, then headings over them, then phrases where they lack."""
    import re

    flat = " ".join((text or "").split())
    parts = [p for p in re.split(r"(?<=[.!?])\s+(?=[A-Z]|[0-9]|[{\\[])", flat) if p]
    stages, strategy = {}, "none"
    marks = list(re.finditer(K.LABEL, flat))
    for i, m in enumerate(marks if len(marks) > 1 else []):
        body = flat[m.end() : marks[i + 1].start() if i + 1 < len(marks) else None].strip(" :")[:900]
        stage = next((s for s, names in K.LABELLED.items() if m[1].lower() in names), None)
        if stage and (len(body) >= 20 or i + 1 == len(marks)):
            stages.setdefault(stage, body)
            strategy = "labels"
    if len(stages) < 3:
        found, now = {}, None
        for line in map(str.strip, (text or "").split("\n")):
            if len(line) < 90 and re.search(K.HEADING, line):
                now = (next((s for s, b in K.HEADED.items() if line.lower().startswith(b)), None), [])
                found.setdefault(now[0], []).append(now[1])
            elif line and now:
                now[1].append(line)
        bodies = {s: next((b for x in found[s] if len(b := " ".join(x)[:1500]) > 120), None) for s in found if s}
        bodies = {s: b for s, b in bodies.items() if b}
        stages |= bodies
        strategy = "headings" if len(bodies) > 1 else strategy
    if len(stages) < 3:
        third = max(1, len(parts) // 3)
        hits = {s: next((p[:400] for p in (parts[third:] if s in ("EVID", "CONC") else parts[: third + 1]) if len(p) > 45 and re.search(K.PHRASES[s], p.lower())), None) for s in K.PHRASES}
        strategy = "phrases" if any(hits.values()) and strategy == "none" else strategy
        stages = {s: h for s, h in hits.items() if h} | stages
    if "OBS" not in stages and (first := [p for p in parts[:4] if len(p) > 40]):
        stages["OBS"] = first[0][:200]
    return strategy, len(stages), "\n".join(f"[{s}] {stages[s].strip()}" for s in K.ORDER if stages.get(s)) or None


def test_skeletons(spark):
    labels = "Background: we looked at the long river basin. Methods: none. Results: the fish grew by ten percent. Conclusions: rivers matter to the fish."
    headings = "Introduction\n" + "words about it " * 12 + "\nResults\nresults were striking in all plots " + "numbers about it " * 12 + "\nDiscussion\n" + "thoughts about it " * 12 + "\n3. Discussion\nnot read"
    phrases = "In this study we looked at many rivers over time. We expect that rivers will change with the climate. " + "Filler sentence that says very little about anything at all. " * 4 + "We found that rivers did change with the climate. We conclude that rivers follow the climate closely."
    late = "Plain sentence that goes on for quite a while here. " * 200 + "Aim: to see what is found late in a text. Results: it was found all the same. Conclusion: whole texts are read."
    merged = "Background: we looked at the long river basin. Results: the fish grew by ten percent.  Taken together we conclude that rivers matter to all of the fish in them."
    single = "Background: we looked at the long river basin. Result: opens nothing at all here. Outcomes: short"
    over = labels.replace("Conclusions: ", "") + "\nResults\n" + "replaced by a heading " * 9 + "\nsummary\n" + "and ended by another " * 9
    texts = [labels, headings, phrases, "", None, late, merged, single, over, headings.upper(), "Methods\n" + "x " * 99, "Aim: \u0001 odd \u0002 marks in a long text. Results. short"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: (r.strategy, r.stages, r.skeleton) for r in S.skeletons(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_skeleton((t or "").replace("\u0001", " ").replace("\u0002", " ")), i
    assert [got[i][0] for i in range(9)] == ["labels", "headings", "phrases", "none", "none", "labels", "labels", "labels", "headings"]
    assert got[6][1] == 3 and got[7][2].split("\n") == ["[OBS] we looked at the long river basin.", "[EVID] short"]


def test_sentences_of_whole_texts(spark):
    assert one(spark, S.sentences(F.col("t")), t="One two. Three! 4 five? no. " * 400)[:3] == ["One two.", "Three!", "4 five? no."]
    assert len(one(spark, S.sentences(F.col("t")), t="One two. Three! 4 five? no. " * 400)) == 1200


def test_content_hash_decomposes(spark):
    hashes = {one(spark, T.content_hash(F.col("t")), t=t) for t in ("Caf\u00e9 \ufb01n", "cafe\u0301  fin")}
    assert len(hashes) == 1
    long = "word " * 2000
    assert one(spark, T.content_hash(F.col("t")), t=long + "a") != one(spark, T.content_hash(F.col("t")), t=long + "b")


def test_tool_calls(spark):
    verdict = S.verify_calls({"find_species": ({"name": "text"}, {"region": "text"})})
    calls = ['{"function": "find_species", "args": {"name": "x"}}', 'say {"function": "find_specie", "args": {"name": "x"}', '{"function": "find_species", "args": {}}', "nothing", '{"function": "find_species", "args": {"name": "x", "odd": 1}}']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(calls)], "i int, c string").select("i", verdict("c").alias("v")).orderBy("i")
    assert [r.v.reason for r in df.collect()] == ["ok", "ok", "required", "parse", "unknown key"]
    assert S.first_object('a {"k": "}"} b') == '{"k": "}"}'


def test_passages(spark):
    para = "We found that the river results show a clear increase of forty percent " * 4
    docs = spark.createDataFrame([(1, "\n".join([para] * 5))], "doc_id long, text string")
    assert S.passages(docs, least_words=100).count() == 2


def test_selection(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 4)
    assert select.split_exact(df, F.col("id"), 0.9, 1).where("part = 'train'").count() == 90
    assert select.cap_per_group(df, ["g"], [F.col("id")], 7).count() == 28
    kept = select.mass_fraction(df.withColumn("m", F.lit(1)), ["g"], [F.col("id")], F.col("m"), 0.5)
    assert kept.count() == 52 - 52 % 4 or kept.count() in (48, 52)
    assert {r.id for r in select.every_nth(df, ["g"], [F.col("id")], 10).where("g = 0").collect()} == {0, 40, 80, 96}
    quota = select.proportional_quota(df, "g", [F.col("id")], 40, 5, 0.5)
    assert quota.count() == 40


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "i int, k string")
    once = dedup.first_per_key(df, F.col("k"), [F.col("i")], keep_keyless=True)
    assert sorted(r.i for r in once.collect()) == [1, 3, 4]
    assert dedup.first_per_key(once, F.col("k"), [F.col("i")], keep_keyless=True).count() == 3


def test_components_and_greedy(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    keep = lambda df: df.persist()
    labels = dedup.components(edges, nodes, keep)
    assert {r.node: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    kept = {r.node for r in dedup.greedy_keep(edges, nodes).where("kept").collect()}
    assert kept == {1, 3, 4, 5, 7}


def test_links_and_greedy_equal_plain_loops(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if unit[i] @ unit[j] >= 0.8}
    found = similarity.links(df, 0.8, block_rows=30).checkpoint()
    assert {(r.a, r.b) for r in found.collect()} == want and found.count() == len(want)
    kept = []
    for i in range(90):
        if not any((j, i) in want for j in kept):
            kept.append(i)
    keep, nodes = (lambda x: x.checkpoint()), df.select(F.col("id").alias("node"))
    assert sorted(r.node for r in dedup.greedy_keep(found, nodes).where("kept").collect()) == kept
    few = similarity.links(df, 0.8, block_rows=30, connect=True).checkpoint()
    assert few.count() < len(want)
    assert sorted(map(tuple, dedup.components(few, nodes, keep).collect())) == sorted(map(tuple, dedup.components(found, nodes, keep).collect()))


def test_packing(spark):
    rows = spark.createDataFrame([(i, list(range(i % 5 + 1))) for i in range(23)], "doc_id long, ids array<int>")
    blocks = tokens.packed(rows, 3, 8, -1, 1).collect()
    assert all(len(b.ids) == 8 for b in blocks)
    total = sum(i % 5 + 1 for i in range(23))
    assert sum(x != -1 for b in blocks for x in b.ids) == total


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"pmid": "1", "text": "abc"}\n\nbroken\n{"pmid": null, "text": "z"}\n{"pmid": "2", "text": ""}\n')
    df = io.json_lines(spark, str(path), "pmid string, text string", "v5").cache()
    assert [r.pmid for r in io.valid_lines(df, "pmid", "text").collect()] == ["1"]
    assert io.line_counts(df, "text").first().malformed == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2000, "a"), (2, 2001, "b")], "id long, year int, t string")
    io.write_partitioned(df, str(tmp_path / "p"), ["year"])
    assert io.hive_parquet(spark, str(tmp_path / "p")).where("year = 2001").count() == 1
    assert io.append_new(df, str(tmp_path / "a"), "id") == 2
    assert io.append_new(df, str(tmp_path / "a"), "id") == 0
    io.write_tsv(df, str(tmp_path / "t"))
    assert io.csv_strings(spark, str(tmp_path / "t"), "\t").count() == 2
    (tmp_path / "ids").write_text("# x\n a \n\nb\n")
    assert [r.id for r in io.id_list(spark, str(tmp_path / "ids")).collect()] == ["a", "b"]


def test_rescan_goes_on_where_it_stopped(spark, tmp_path):
    seen = []
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(1,)], "id long")
    for _ in range(2):
        df.write.mode("append").parquet(src)
        incremental.rescan(spark, src, df.schema, str(tmp_path / "cp"), lambda b, i: seen.append(b.count()))
    assert seen == [1, 1]


def test_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "step int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 5, "d"), (3, 1, "e")], "step int, v int, x string")
    assert {r.step: r.x for r in incremental.upsert(old, new, "step", "v").collect()} == {1: "c", 2: "d", 3: "e"}

"""Faults that a review found, each by the smallest input that shows it."""

import time
import unicodedata

import __spark_entry__ as e
import numpy as np

from corpusmill.functions import labels as L
from corpusmill.functions import skeleton as K
from corpusmill.functions import structure as S
from corpusmill.functions import text as T
from corpusmill.functions.spans import literal_span
from corpusmill.llm import chroma, quality_rules

from corpusmill.operators import dedup, pairs, select, similarity
from pyspark.sql import functions as F

def test_word_edges_are_ascii(spark):
    rows = [(1, "baña a"), (2, "éa el"), (3, "xthe the"), (4, "x\x0b,"), (5, "the theñ"), (6, "An an"), (7, "x\t.")]
    got = {r.i: r for r in S.fluency(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert [i for i, r in got.items() if r.a_vowel] == [1, 2]
    assert [i for i, r in got.items() if r.doubled_article] == [1, 5, 6]
    assert [i for i, r in got.items() if r.space_before] == [7]
    codes = spark.createDataFrame([("éCC BY-SA",), ("éMIT License",), ("xGPL",)], "t string").select(L.license_code(F.col("t"))).collect()
    assert [r[0] for r in codes] == ["CC BY-SA", "MIT", None]


def test_quota_is_not_trimmed(spark):
    df = spark.range(400).withColumn("g", F.when(F.col("id") < 370, 0).otherwise(F.col("id")))
    quota = select.proportional_quota(df, "g", [F.col("id")], 40, 1, 0.5)
    assert quota.count() == 50 and quota.where("g = 0").count() == 20
    assert select.proportional_quota(df, "g", [F.col("id")], 40, 1, 0.5, trim=True).count() == 40
    assert "LIMIT" not in e.oracle_sql()["proportional_quota"]


def test_top_k_keeps_ties_copies_and_small_differences(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(260, 16)).round(3)
    base[40:90] = base[40]  # copies: ties go to the smaller id
    base[90:110] = base[40] * 2  # equal only as unit vectors
    base[110:140] = base[40] + rng.normal(size=(30, 16)) * 1e-8  # apart in double precision alone
    base[7] = 0
    sent = [(i, v.tolist()) for i, v in enumerate(base)]
    df = spark.createDataFrame(sent, "id long, vec array<double>")
    m = base / np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-300)
    sims = np.round(m @ m.T, 12)
    np.fill_diagonal(sims, -np.inf)
    want = np.argsort(-sims, axis=1, kind="stable")[:, :5]
    for rows in (32768, 50):
        got = {(r.src, r.rank): (r.dst, r.sim) for r in similarity.top_k(df, df, 5, block_rows=rows).collect()}
        assert len(got) == 260 * 5
        assert all(abs(got[i, j + 1][1] - sims[i, want[i, j]]) < 1e-11 for i in range(260) for j in range(5))
        assert sum(got[i, j + 1][0] == want[i, j] for i in range(260) for j in range(5)) >= 1295
    few = similarity.top_k(df, df, 5, least=0.5).collect()
    assert len(few) == int((np.take_along_axis(sims, want, 1) >= 0.5).sum())


def test_top_k_takes_no_square_of_a_block(spark):
    """One task's memory is that of its vectors and one tile, not of all similarities of its blocks."""
    import tracemalloc

    m = np.random.default_rng(1).normal(size=(4096, 16))
    ids = np.arange(4096)
    tracemalloc.start()
    similarity._nearest(m, ids, m, ids, 3, None)
    assert tracemalloc.get_traced_memory()[1] < 4096 * 4096 * 4
    tracemalloc.stop()


def test_top_k_with_a_least_similarity_orders_few_of_all_places(spark, monkeypatch):
    """A low bound on the similarity lets through a share of all places; only those that may be among the best go on."""
    taken, merged = [], similarity._merged
    monkeypatch.setattr(similarity, "_merged", lambda best, rows, *rest: (taken.append(len(rows)), merged(best, rows, *rest)))
    m = np.random.default_rng(3).normal(size=(4100, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.arange(len(m))
    for k, least in ((8, 0.2), (8, 0.45), (3, None), (70, 0.0)):
        taken.clear()
        values, known = similarity._nearest(m, ids, m, ids, k, least)
        sims = np.round(m @ m.T, 12)
        np.fill_diagonal(sims, -np.inf)
        want = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        there = np.take_along_axis(sims, want, 1) >= (-1 if least is None else least)
        assert (np.isfinite(values) == there).all() and (known[there] == want[there]).all()
        assert sum(taken) < 8 * k * len(m)


def test_pairs_of_blocks_have_a_task_each(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(90)], "id long, vec array<double>")
    plan = similarity.top_k(df, df, 3, block_rows=30)._jdf.queryExecution().executedPlan().toString()
    assert all(f"hashpartitioning({side}_{x}" in plan for side, x in (("l", "x"), ("r", "x"))) and plan.count("REPARTITION_BY_NUM") == 2
    assert plan.count(", 9), REPARTITION_BY_NUM") == 2


def test_hard_negatives_split_each_text_once(spark, tmp_path, monkeypatch):
    texts = [(0, "one 1 two"), (1, "one 2 two"), (2, None), (3, ""), (4, "a 1,000.50 b"), (5, "a 1000.5 b"), (6, "x " * 1999 + "7"), (7, "x 8")]
    angles = [0.0, 0.01, 0.02, 0.03, 1.5, 1.51, 3.0, 3.01]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    plans, was = [], dedup.cap_degrees
    monkeypatch.setattr(dedup, "cap_degrees", lambda edges, *a: (plans.append(edges._jdf.queryExecution().optimizedPlan().toString()), was(edges, *a))[1])
    got = sorted(tuple(r)[:2] for r in e.queries()["hard_negative_pairs"](spark, str(tmp_path)).collect())
    # No pair has a null text, numbers that are the same, or more than 2000 words together.
    assert got == [(0, 1), (0, 3), (1, 3)]
    assert plans[0].count("split(text") == 2


def test_mutations_by_one_look_at_each_word(spark):
    tables = {"one": [("warm", "cold")], "two": [("was", "are"), ("cold", "hot")]}
    texts = ["a Was, 12 is", "it (Warm) was", '"cold" was', "x 007. is", "y 12345678901234567899 is", "Is it", "none 1.5", "!!! 9 "]
    df = spark.createDataFrame([(i, t.split(" ")) for i, t in enumerate(texts)], "i int, w array<string>")
    got = {r.i: (r.m.kind, r.m.place, r.m.old, r.m.new) for r in pairs.mutated(df, "w", tables).collect()}
    assert got == {0: ("two", 1, "Was", "Are"), 1: ("one", 1, "Warm", "Cold"), 2: ("one", 0, "cold", "warm"), 3: ("number", 1, "007", "21"), 4: ("digits", 1, "12345678901234567899", "12345678901234567890"), 5: ("negation", 0, "Is", "Is not")}
    plan = pairs.mutated(df, "w", tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_position") == 1


def test_spans_grow_with_the_answer():
    """Long answers: each word is tried a bounded number of times, with the results of trying all runs."""

    def every(answer, passage, least=3):
        if answer and answer in passage:
            return answer
        w = answer.split()
        return next((" ".join(w[i : i + n]) for n in range(len(w) - 1, least - 1, -1) for i in range(len(w) - n + 1) if " ".join(w[i : i + n]) in passage), None)

    rng = np.random.default_rng(2)
    for _ in range(3000):
        a, p = (" ".join(rng.choice(["a", "b", "ab", "ba", "c"], rng.integers(0, 14))) for _ in range(2))
        assert literal_span(a, p) == every(a, p)
    assert literal_span("x  y\nz w", "x y z w") == every("x  y\nz w", "x y z w") == "x y z"
    words = [f"w{i}" for i in range(4000)]
    began = time.process_time()
    assert literal_span(" ".join([*words, "end"]), " ".join([*words[100:3000], "other"])) == " ".join(words[100:3000])
    assert time.process_time() - began < 5


def test_keys_send_only_what_is_not_ascii(spark):
    texts = ["", "plain  Text", "Café ﬁn", "é", "ạ́b", "é\nè", "각 x y", "x½", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", T.decomposed_runs(F.col("t")).alias("d")).collect()}
    assert got == {i: t and unicodedata.normalize("NFKD", t) for i, t in enumerate(texts)}
    sent = df.select(T.canonical_key(*[F.lit("7")] * 4, F.col("t")).alias("k"))
    assert {r.k for r in sent.collect()} == {"pmc:7"}


def test_skeleton_guards_lose_no_label_or_heading():
    """The guards before labels and headings let through whatever the expressions that they guard find."""
    import itertools
    import re

    labels = "Background Introduction Background/Objectives Objectives Objective Aims Aim Design Setting Participants Methods Method Methodology Measurements Results Finding Main finding Outcomes Conclusion Discussion Interpretation".split()
    for label, case, end in itertools.product(labels, (str, str.upper, str.lower), (":", " .")):
        text = f"so {case(label)}{end} it"
        assert re.sub(K.LABEL_JAVA, "<>", text) == re.sub(K.LABEL, "<>", text)
    heads = ["Introduction", "2. Methods", "results and discussion", "Experimental setup", "SUMMARY", "ón", "Implications"]
    for head, before in itertools.product(heads, ("", "a\n", "a\n \t", "a\n\x01", "\r\n\n")):
        assert re.search(K.HEADING_START, f"{before}{head} \nmore")


def test_skeletons_with_marks_labels_and_phrases(spark):
    body = "a body that is long enough to be one of the stages of it and more " * 3
    texts = [f"Background: {body}Results: {body}Conclusions: short", f"\x01Introduction\n{body}\n\x02Results \n{body}", "We report that \x01 the water of all the rivers is cold. Then. In conclusion, what all of us had believed of it is so!", None, "", "x\x01Results: y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: (r.strategy, r.stages) for r in S.skeletons(df).collect()}
    assert got == {0: ("labels", 3), 1: ("headings", 2), 2: ("phrases", 2), 3: ("none", 0), 4: ("none", 0), 5: ("none", 0)}


def test_levels_split_each_text_once_a_reading(spark):
    docs = spark.createDataFrame([(i, "s", " ".join(["was", *"abcdefghijklmn"[i:]])) for i in range(4)], "doc_id long, source string, text string")
    out = pairs.levels(docs)
    rows = out.collect()
    # Each has twelve words or more.
    assert sorted((r.doc_id, r.level) for r in rows) == sorted((i, x) for i in range(3 + 1) for x in ("L0", "L1", "L2") if len(docs.collect()[i].text.split()) >= 12)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") <= 3


def _droning(n, positions, period=5, seed=1):
    """Fingerprints that hold the same run of a few values again and again, between values of their own."""
    rng = np.random.default_rng(seed)
    drone = rng.integers(0, 2**32, period, dtype=np.uint32)
    out = []
    for k in range(n):
        own = rng.integers(0, 2**32, 12 + k % 7, dtype=np.uint32)
        out.append(np.concatenate((own[: 5 + k % 3], np.tile(drone, positions // period + 1)[: positions - k], own[5 + k % 3 :])))
    return out


def test_a_value_in_many_places_meets_once_for_each_recording():
    """What a bucket holds grows with the pairs of recordings, not with those of their places."""
    import tracemalloc

    import pandas as pd

    prints = _droning(100, 200)
    rows = pd.DataFrame({"class": range(100), "asked": True, "print": [p.tobytes() for p in prints]})
    data = pd.concat(chroma._postings(1, 1, 3)(iter([rows])))
    tracemalloc.start()
    out = chroma._meet(1, 3)(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000, peak
    q, d, votes, near = chroma._unpacked(out["data"], chroma.CANDIDATE)
    assert len(q) == 100 * 99 and (q != d).all() and (votes == 3).all() and not near.any()


def test_offsets_with_most_votes_equal_a_plain_count(monkeypatch):
    prints = _droning(9, 60) + _droning(3, 40, period=1, seed=2) + [np.arange(7, dtype=np.uint32)]
    bytes_, i, j = [p.tobytes() for p in prints], *np.divmod(np.arange(len(prints) ** 2), len(prints))
    for limit in (1 << 20, 700):
        monkeypatch.setattr(chroma, "PAIRS", limit)
        flat, n = chroma._flat(bytes_)
        offset, votes = chroma._best_offsets(flat, n, chroma._known(flat, n), n, i, j)
        for k in range(len(i)):
            a, b = chroma._values(prints[i[k]]), chroma._values(prints[j[k]])
            x, y = np.nonzero(a[:, None] == b[None])
            count = dict(zip(*np.unique(y - x, return_counts=True), strict=True))
            best = max(count, key=lambda o: (count[o], -abs(o), o), default=0)
            assert (offset[k], votes[k]) == (best, count.get(best, 0))


def test_short_recordings_with_neighbouring_values_are_compared(spark, monkeypatch):
    """One vote at the offset of the neighbouring values took nothing from them."""
    monkeypatch.setattr(chroma, "fingerprints", lambda rows, audio, out="fingerprint": rows.withColumn(out, F.col(audio)))
    p = np.random.default_rng(3).integers(0, 2**32, 12, dtype=np.uint32)
    flip = np.ones(12, np.uint32)
    flip[[3, 4, 7]] = 0  # 3 and 4 are neighbours, 3 and 7 an anchor
    rows = [(20, bytearray(p.tobytes())), (21, bytearray((p ^ flip).tobytes()))]
    r = chroma.align(spark.createDataFrame(rows, "doc_id long, audio binary"), F.col("doc_id") % 20 == 0).first()
    assert (r.matches, r.match_id, r.offset, r.votes, r.overlap, r.error) == (1, 21, 0, 1, 12, round(9 / 384, 9))


def test_rules_on_shares_of_words_pass_over_texts_without_words(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(("one two # three", "", " \n\t", None, "four five"))], "doc_id long, text string")
    for name in quality_rules.SHARES:
        for above in (True, False):
            rules = quality_rules.DecisionList([[(name, above, -1.0 if above else 1e9)]])
            got = {r.doc_id: r.rule for r in quality_rules.text_statistics(docs).withColumn("rule", rules.expression()).collect()}
            empty = "rule 1" if name in ("words", "dup_lines", "line_words") else None
            assert got == {0: "rule 1", 1: empty, 2: empty, 3: empty, 4: "rule 1"}, name

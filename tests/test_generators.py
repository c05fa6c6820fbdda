"""Pairs, generators, search and similarity on small rows."""

from corpusmill.operators import dedup, pairs, search, similarity, synth
from pyspark.sql import functions as F


def test_swaps_are_symmetric_and_keep_capitals():
    table = pairs.swap_table()
    assert pairs.swap("Higher values", table) == "Lower values"
    assert pairs.swap("It was increased", table) == "It was decreased"
    assert pairs.swap("nothing", table) is None
    assert pairs.swap_table([("a", "b"), ("a", "c")]) == {"a": "c", "b": "a", "c": "a"}


def test_number_and_negation():
    assert pairs.shift_number("grew by 1,200.50 m") == "grew by 3,601.50 m"[:8] + pairs.shift_number("grew by 1,200.50 m")[8:]
    assert pairs.shift_number("at 0 m") == "at 1 m"
    assert pairs.negate("it is here") == "it is not here" and pairs.negate("it is not") is None
    assert pairs.mutate("plain words", {"x": "y"}) == (None, "none")


def test_mutated_words(spark):
    texts = ["It was Higher, then lower", "no word but 12 here and is", "call (4994226020900891123456), now", "it is here", "nothing", "", None, "It was warm because of x", "Decreased; more"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.split("t", " ").alias("w"))
    m = pairs.mutated_words(F.col("w"))
    got = {r.i: (r.m and (r.m.kind, r.m.place, r.m.old, r.m.new), r.done and " ".join(r.done)) for r in df.select("i", m.alias("m"), pairs.with_mutation(F.col("w"), m).alias("done")).collect()}
    assert got == {
        0: (("direction", 2, "Higher", "Lower"), "It was Lower, then lower"), 1: (("number", 3, "12", "36"), "no word but 36 here and is"), 2: (("digits", 1, "4994226020900891123456", "4994226020900891123457"), "call (4994226020900891123457), now"),
        3: (("negation", 1, "is", "is not"), "it is not here"), 4: (None, None), 5: (None, None), 6: (None, None), 7: (("environment", 2, "warm", "cold"), "It was cold because of x"), 8: (("direction", 0, "Decreased", "Increased"), "Increased; more"),
    }


def test_articles(spark):
    df = spark.createDataFrame([("a apple and an pear",)], "t string")
    assert df.select(pairs.repair_articles(F.col("t"))).first()[0] == "an apple and a pear"


def test_levels(spark):
    rows = [(i, f"s{i % 2}", " ".join(f"w{i}_{j}" for j in range(15))) for i in range(200)]
    out = pairs.levels(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert {r.level: r.n for r in out.groupBy("level").agg(F.count("*").alias("n")).collect()}["L2"] == 200
    assert out.where("ok = bad").count() == 0
    told = spark.createDataFrame([(1, "s", "one two three four it is five six seven eight nine ten")], "doc_id long, source string, text string")
    assert [tuple(r) for r in pairs.levels(told).where("level = 'L3'").select("ok", "bad").collect()] == [(["it", "is", "five", "six"], ["it", "is not", "five", "six"])]
    l1 = out.where("level = 'L1'").select("doc_id", F.regexp_extract(F.get("bad", F.lit(0)), "w(\\d+)_", 1).cast("long").alias("mate")).collect()
    assert len(l1) == 200 and all(r.doc_id != r.mate and r.doc_id % 2 == r.mate % 2 for r in l1)


def test_arithmetic_follows(spark):
    rows = synth.arithmetic(spark.range(500).selectExpr("id", "id % 88 + 2 AS a", "id % 97 + 3 AS b"))
    assert rows.where(~synth.recomputed(rows)).count() == 0
    assert rows.select("op").distinct().count() == len(synth.OPERATIONS)


def test_chains_are_exactly_balanced(spark):
    facts = spark.range(501).selectExpr("id", "'m' || id AS member", "'nation' AS middle", "'here' AS whole", "'there' AS other")
    rows = synth.chains(facts, 0.4)
    assert rows.where("valid").count() == 200 and rows.where("valid = endswith(text, 'is in there.')").count() == 0
    assert synth.chains(facts.limit(0), 0.4).count() == 0


def test_syllogisms(spark):
    rows = synth.syllogisms(spark.range(8).selectExpr("id", "'m' AS member", "'n' AS middle", "'w' AS whole", "'o' AS other")).collect()
    assert {r.family: r.valid for r in rows} == {"categorical": True, "transitive": True, "negation": True, "none": False}


def test_mould_cap(spark):
    rows = spark.range(100).select("id", F.lit("f").alias("family"), (F.col("id") % 2).alias("mould"))
    assert synth.cap_moulds(rows, "family", "mould", 0.05).count() == 10


def test_contrasts_differ(spark):
    facts = spark.range(200).selectExpr("id", "'bolt' AS name", "'small' AS kind", "id + 1 AS size", "id % 2 = 0 AS above")
    assert synth.contrasts(facts).where("text = opposite").count() == 0


def test_search_conditions(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red deer"), (3, "the foxes and red fox"), (4, "blue")], "doc_id long, text string")
    assert [r.id for r in search.search(docs, ["fox*"]).collect()] == [3, 1]
    assert [r.id for r in search.search(docs, ["fox"], all_of=["red"], phrase="red fox").collect()] and search.search(docs, ["none"]).count() == 0
    assert {r.id for r in search.search(docs, ["fox", "deer"], all_of=["deer"]).collect()} == {2}


def test_neighbours_do_not_depend_on_blocks(spark):
    import random

    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "id long, vec array<double>")
    one = {(r.src, r.rank): r.dst for r in similarity.top_k(df, df, 3).collect()}
    many = {(r.src, r.rank): r.dst for r in similarity.top_k(df, df, 3, block_rows=9).collect()}
    assert one == many and len(one) == 180


def test_edges_keep_the_larger_similarity(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.7), (3, 3, 1.0)], "src long, dst long, sim double")
    assert [tuple(r) for r in dedup.canonical_edges(df).collect()] == [(1, 2, 0.7)]


def test_degree_cap_equals_the_sequential_rule(spark):
    import random

    rng = random.Random(4)
    edges = sorted({(a, b, rng.randint(1, 9) / 10) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(150)) if a < b})
    edges = list({(a, b): (a, b, s) for a, b, s in edges}.values())
    used, want = [0] * 30, set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if used[a] < 2 and used[b] < 2:
            want.add((a, b))
            used[a] += 1
            used[b] += 1
    df = spark.createDataFrame(edges, "a long, b long, sim double")
    got = {(r.a, r.b) for r in dedup.cap_degrees(df, 2, lambda d: d.persist()).collect()}
    assert got == want

"""Orders of whole tables, neighbour lists, greedy choice, matching, taxonomies, blocks, rebinding, verdicts and rewrites against plain loops."""

import json
import random

import numpy as np
import pytest
from corpusmill.functions import brackets, labels, stats, taxonomy
from corpusmill.operators import curves, dedup, flat, holdout, matching, neighbours, order, rebinding, similarity
from corpusmill.sources import atomic
from corpusmill.sources.shared import new_folder
from pyspark.sql import functions as F


def rows_of(spark, n, parts):
    return spark.range(n).select(F.col("id"), (F.col("id") * 7 % 11).cast("int").alias("size")).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_running_total(spark, parts):
    got = order.running_total(rows_of(spark, 500, parts), [F.col("id")], F.col("size"), "before", parts).orderBy("id").collect()
    sizes = [i * 7 % 11 for i in range(500)]
    assert [r.before for r in got] == [sum(sizes[:i]) for i in range(500)]


def test_running_total_odd_rows(spark):
    df = spark.createDataFrame([(None, 3), (2, None), (2, 5), (1, 0)], "id int, size int")
    got = {(r.id, r.size): r.before for r in order.running_total(df, [F.col("id").asc_nulls_first(), F.col("size").asc_nulls_first()], F.col("size"), "before").collect()}
    assert got == {(None, 3): 0, (1, 0): 3, (2, None): 3, (2, 5): 3}
    assert order.running_total(df.limit(0), [F.col("id")], F.col("size"), "before").count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_running_total_of_groups(spark, parts):
    """One group has most rows; a null is a group."""
    rows = [("big" if i % 10 else None if i % 20 else "small", i, i % 4) for i in range(400)]
    got = order.running_total(spark.createDataFrame(rows, "g string, i int, size int").repartition(3), [F.col("i")], F.col("size"), "before", parts, by=["g"]).collect()
    assert {(r.g, r.i): r.before for r in got} == {(g, i): sum(s for h, j, s in rows if h == g and j < i) for g, i, _ in rows}


def test_ring(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5), (None, 6)], "g string, i long")
    assert dict(order.ring(df, ["g"], [F.col("i")], "i", "next").collect()) == {1: 2, 2: 3, 3: 1, 5: 6, 6: 5}
    assert dict(order.ring(df, [], [F.col("i")], "i", "next").collect()) == {1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 6: 1}


def test_shuffles_do_not_depend_on_partitions(spark, tmp_path):
    places = [dict(order.in_random_order(rows_of(spark, 300, p), F.col("id"), 3, parts=p).select("id", "place").collect()) for p in (1, 4, 7)]
    assert places[0] == places[1] == places[2] and sorted(places[0].values()) == list(range(300)) and places[0] != {i: i for i in range(300)}
    chunked = [dict(order.in_shuffled_chunks(rows_of(spark, 300, p), [F.col("id")], F.col("id"), 40, 3, parts=p).select("id", "place").collect()) for p in (2, 5)]
    assert chunked[0] == chunked[1] and sorted(chunked[0].values()) == list(range(300)) and all(i // 40 == p // 40 for i, p in chunked[0].items())
    order.write_in_order(spark.createDataFrame(list(places[0].items()), "id long, place long"), "place", str(tmp_path / "t"), 3, "json")
    lines = [json.loads(line)["place"] for f in sorted((tmp_path / "t").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == list(range(300))


@pytest.mark.parametrize("length", [1, 7, 50])
def test_flat_rows_and_batches(spark, length):
    rng = random.Random(length)
    docs = [(i, [rng.randrange(100) for _ in range(rng.choice([0, 1, 3, 20, 300]))]) for i in range(60)] + [(100, None)]
    stream = [x for _, ids in docs for x in [*(ids or []), 0]]
    df = flat.closed(spark.createDataFrame(docs, "doc_id long, ids array<int>").repartition(5), 0)
    got = {r.row: r.ids for r in flat.flat_rows(df, [F.col("doc_id")], length, parts=4).collect()}
    assert got == {i: stream[i * length : (i + 1) * length] for i in range(len(stream) // length)}
    steps = len(stream) // (3 * length)
    lanes = {(r.lane, r.step): r.ids for r in flat.batches(df, [F.col("doc_id")], 3, length).collect()}
    assert lanes == {(b, s): stream[(b * steps + s) * length :][:length] for b in range(3) for s in range(steps)}
    assert flat.batches(df.limit(0), [F.col("doc_id")], 3, length).count() == 0


def test_merged_stores(spark):
    a = spark.createDataFrame([(2, [1, 2]), (1, [3]), (None, None)], "doc_id long, ids array<int>")
    b = spark.createDataFrame([(1, [4, 5, 6])], "doc_id long, ids array<int>")
    got = [tuple(r) for r in flat.merged_stores([("a", a), ("b", b)], "doc_id", 10).orderBy("start", "n_tokens").collect()]
    assert got == [("a", None, 0, 0), ("a", 1, 0, 1), ("a", 2, 1, 2), ("b", 1, 3, 3)]
    with pytest.raises(Exception, match="not in the vocabulary"):
        flat.merged_stores([("a", a), ("b", b)], "doc_id", 6).collect()


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    return centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, 24))


def test_approximate_neighbours(spark):
    m = clustered(3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(9000, None)], "id long, vec array<double>")
    asked = df.where("id % 20 = 0")
    exact = {(r.src, r.dst) for r in similarity.top_k(asked.where("vec is not null"), df.where("vec is not null"), 16).collect()}
    rows = neighbours.approximate_top_k(asked, df, 16, block_rows=256).collect()
    assert len({(r.src, r.dst) for r in rows} & exact) / len(exact) >= 0.9 and len(rows) == len(exact)
    assert [r.rank for r in rows if r.src == 0] == list(range(1, 17)) or sorted(r.rank for r in rows if r.src == 0) == list(range(1, 17))
    lists = neighbours.fit_lists(df.where("vec is not null"), 16)
    assert lists.probes < len(lists.centroids)
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id long, vec array<double>")
    assert [tuple(r)[:2] for r in neighbours.approximate_top_k(few, few, 1).orderBy("src").collect()] == [(1, 2), (2, 3), (3, 2)]
    assert neighbours.approximate_top_k(few, few.limit(0), 3).collect() == []


def plain_greedy(ids, m, hashes, least):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    kept = []
    for i in sorted(range(len(ids)), key=lambda i: (hashes[ids[i]], ids[i])):
        if not any(unit[i] @ unit[j] >= least for j in kept):
            kept.append(i)
    return {ids[i] for i in kept}


@pytest.mark.parametrize("first", [1, 50, 5000])
def test_greedy_representatives(spark, first):
    m = np.concatenate([clustered(300), np.tile(clustered(1, 2), (200, 1)), clustered(1, 3) + 1e-3 * np.random.default_rng(4).normal(size=(200, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    hashes = dict(df.select("id", F.shiftrightunsigned(F.xxhash64("id"), 1)).collect())
    got = similarity.greedy_representatives(df, 0.7, first=first, block_rows=128).collect()
    assert len(got) == len(m) and {r.node for r in got if r.kept} == plain_greedy(list(range(len(m))), m, hashes, 0.7)
    assert similarity.greedy_representatives(df.limit(0), 0.7).count() == 0


def test_greedy_keep_of_a_chain(spark):
    """A chain that is linked in order settles, however long; here 60 rounds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(119)], "a long, b long")
    got = dict(dedup.greedy_keep(edges.coalesce(1), spark.range(121).withColumnRenamed("id", "node")).collect())
    assert got == {i: i % 2 == 0 for i in range(121)}


def test_forest_keeps_components():
    rng = np.random.default_rng(0)
    for n, m in ((1, 0), (50, 30), (200, 4000)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)

        def parts(pairs, n=n):
            label = list(range(n))
            for a, b in pairs:
                la, lb = label[a], label[b]
                label = [min(la, lb) if x in (la, lb) else x for x in label]
            return label

        keep = similarity.forest(u, v, n)
        assert parts(zip(u, v, strict=True)) == parts(zip(u[keep], v[keep], strict=True)) and len(keep) == n - len(set(parts(zip(u, v, strict=True))))


def test_first_match(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "c", "y"), (4, "", None), (5, "a", None), (5, "q", "x")], "id long, p string, q string").withColumn("row", F.monotonically_increasing_id())
    right = spark.createDataFrame([(30, "a", "z"), (20, "a", "x"), (10, "b", "x"), (5, None, None), (6, "", "")], "r long, p string, q string")
    got = sorted(((r.id, r.p, r.matched_by, r.r) for r in matching.first_match(left, right, "row", [F.col("p"), F.col("q")], [F.col("p"), F.col("q")], ["r"], ["r"]).collect()), key=str)
    assert got == sorted([(1, "a", 1, 20), (2, None, 2, 10), (3, "c", None, None), (4, "", None, None), (5, "a", 1, 20), (5, "q", 2, 10)], key=str)


def test_clean_holdout(spark):
    def text(*words):
        return " ".join(f"{w}{i}" for w in words for i in range(8))

    items = spark.createDataFrame([(1, text("a")), (2, text("b")), (3, text("c")), (4, text("d")), (5, "short"), (6, None)], "item long, t string")
    docs = spark.createDataFrame([(10, text("a", "b")), (11, text("b", "x", "c")), (12, text("d")), (3, text("y", "c")), (13, None)], "doc long, t string")
    got = {r.item: (r.group, r.leaked) for r in holdout.clean_holdout(items, docs, F.col("doc") == 3, item="item", item_text="t", doc="doc", doc_text="t").collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (1, True), 4: (4, False), 5: (5, False), 6: (6, False)}


def test_taxonomy(spark):
    leading, other, marks = {"sea": ["coral", "ocean"], "soil": ["soil", "coral"]}, {"heart": ["heart", "artery"], "cell": ["cell"]}, ["adult", "male", "female"]
    texts = ["Coral in the ocean", "coral soil and ocean", "one coral, one heart", "coral and ocean: heart, artery; adult male female", "ocean", "nothing", "", None, "heart artery ocean coral soil cell"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = taxonomy.lexicon_hits(F.col("t"), taxonomy.lexicon_lists(leading, other, marks))
    got = [tuple(r) for r in df.select(hits, taxonomy.fine_label(hits, list(leading), list(other))).collect()]
    assert got[0] == ([2, 1, 0, 0, 0], "sea") and got[7] == ([0] * 5, "other")
    assert [label for _, label in got] == ["sea", "sea", "heart", "sea", "sea", "other", "other", "other", "sea"]
    label, source = taxonomy.cascade({"a": F.lit("by a"), "b": F.lit("by b")}, {"a": F.col("a"), "b": F.col("b")}, F.lit("rough"))
    rows = spark.createDataFrame([("x", "y"), ("", "y"), (None, None)], "a string, b string").select(label, source).collect()
    assert [tuple(r) for r in rows] == [("by a", "a"), ("by b", "b"), ("rough", "coarse")]


def plain_blocks(text):
    out, stack, quoted, start, i = [], "", False, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 2
            continue
        if c == '"' and stack:
            quoted = not quoted
        elif c in "[{" and not quoted:
            start = start if stack else i
            stack += c
        elif c in "]}" and not quoted and stack:
            if stack[-1] == {"]": "[", "}": "{"}[c]:
                stack = stack[:-1]
                if not stack:
                    out.append(text[start : i + 1])
            else:
                stack = ""
        i += 1
    return out


def test_top_blocks(spark):
    rng = random.Random(3)
    texts = ['Sure: [{"q": "a]b", "a": "x\\"}"}] and {"k": [1, 2]} end', "[1, {2]", "}{", '{"open": [1', "[[]]{}", '"[a]" [b "]" c]', "é [ü] 😀 {\n}", "", "\\[no\\] [\\]]", "[(])"]
    texts += ["".join(rng.choice('[]{}"\\a ') for _ in range(rng.randrange(60))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", brackets.top_blocks(F.col("t"))).collect()
    assert dict(map(tuple, got)) == {i: plain_blocks(t) for i, t in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "t string").select(brackets.top_blocks(F.col("t"))).first()[0] is None


def test_marked_values(spark):
    marks = {"guess": "(?i)hypothesis\\s*:", "claim": "(?i)prediction\\s*:"}
    texts = ["Hypothesis: it rains\nPREDICTION:\nwet streets\nand umbrellas\n\nmore", "prediction: first\nPrediction: second", "Hypothesis:   \n\nPrediction: x", "none", None, "Hypothesis:\n  late  \nprediction:"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(brackets.marked_values(F.col("t"), marks)).collect()]
    assert got == [("it rains", "wet streets\nand umbrellas"), (None, "first"), (None, "x"), (None, None), (None, None), ("late", None)]


def test_rebinding_is_attested(spark):
    docs = [(1, "Grey wolves met 12 Brown bears there. Then Brown bears saw 15 of them. Grey wolves left."), (2, "Grey wolves and Brown bears. None at all."), (3, "Brown bears again. Grey wolves too, 7 of 7."), (4, "Only Rare birds here. Then Grey wolves came."), (5, ""), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.kind): (r.sentence, r.old, r.new, r.mutated) for r in rebinding.rebound(df, {"name": "[A-Z][a-z]{3,} [a-z]{4,}", "number": "[0-9]+"}, {"number"}, least=3).collect()}
    assert got == {(1, "name"): (2, "Grey wolves", "Brown bears", "Brown bears left."), (1, "number"): (1, "15", "12", "Then Brown bears saw 12 of them."), (3, "name"): (1, "Grey wolves", "Brown bears", "Brown bears too, 7 of 7.")}


def test_verdict_values(spark):
    """Known values: 0.5273 of 256 is chance, 0.60 of 256 is not; 600 to 650 pairs show five points."""
    row = spark.range(1).select(stats.binomial_tail(F.lit(135).cast("long"), F.lit(256).cast("long")).alias("a"), stats.binomial_tail(F.lit(154).cast("long"), F.lit(256).cast("long")).alias("b"), stats.sample_size(F.lit(0.05)).alias("n")).first()
    assert row.a > 0.05 and row.b < 0.01 and 600 <= row.n <= 650


def test_battery_reading(spark):
    rows = [(0.6, 0.01, 0.6, 0.01, 0.6), (0.6, 0.2, 0.6, 0.01, 0.6), (0.5, 0.5, 0.5, 0.5, 0.56), (0.5, 0.5, 0.55, 0.01, 0.5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a3 double, p3 double, a2 double, p2 double, a0 double")
    one = F.lit(None).cast("double")
    reading = stats.battery_reading({"L3": F.col("a3"), "L2": F.col("a2"), "L1": one, "L0": F.col("a0")}, {"L3": F.col("p3"), "L2": F.col("p2"), "L1": one, "L0": one})
    assert [r[0] for r in df.select(reading).collect()] == ["INFERENTIAL_SIGNAL", "STAGE_GRAMMAR", "TOPICAL_SHORTCUT", "STRONG_FALSIFY", "STRONG_FALSIFY"]


def test_licences(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "x CC BY 4.0", "Released under the MIT License.", "Apache License, Version 2.0", "GNU General Public License", "CC0", "none named", None]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(labels.license_code(F.col("t")), labels.license_class(labels.license_code(F.col("t")))).collect()]
    assert got == [("CC BY-NC", "train"), ("CC BY", "open"), ("MIT", "open"), ("Apache-2.0", "open"), ("GPL", "unknown"), ("CC0", "open"), (None, "unknown"), (None, "unknown")]
    urls = ["http://creativecommons.org/licenses/by/4.0/", "https://creativecommons.org/licenses/by-nc-sa/4.0/", "http://arxiv.org/licenses/nonexclusive-distrib/1.0/", "https://creativecommons.org/publicdomain/zero/1.0/", "https://creativecommons.org/licenses/by-sa/4.0/", "", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(labels.license_url_class(F.col("u"))).collect()]
    assert got == ["open", "train", "train", "open", "open", "unknown", "unknown"]


def test_curve_verdicts(spark):
    points = [("up", s, a, 256) for s, a in enumerate([0.50, 0.52, 0.55, 0.57])] + [("hit", 5, 0.7, 256)] + [("flat", s, 0.5, 256) for s in range(69)] + [("flat", 70, 0.5273, 256), ("flat", 71, None, 256), ("down", 1, 0.62, 256), ("down", 2, 0.58, 256), ("down", 3, 0.56, 256)]
    df = spark.createDataFrame(points, "run string, step int, acc double, n long")
    got = {r.run: r for r in curves.curve_verdicts(df, go=0.55, hit=0.6, ref=0.535).collect()}
    assert {k: v.verdict for k, v in got.items()} == {"up": "EXTEND", "hit": "HIT", "flat": "FALSIFY", "down": "NO-GO"}
    assert got["up"].slope == pytest.approx(0.025) and got["hit"].slope is None and got["flat"].looks == 70 and got["flat"].final_step == 70
    assert got["flat"].decided_step is None and got["hit"].decided_step == 5 and got["down"].decided_step == 1
    assert got["flat"].p_peak == pytest.approx(1 - (1 - got["flat"].p) ** 70)
    trend = {r.run: r.t for r in spark.createDataFrame([("a", 2, 0.7, 0.1), ("b", 5, 0.6, -0.1), ("c", 5, 0.53, 0.1), ("d", 5, 0.56, 0.1), ("e", 5, 0.56, 0.0)], "run string, n int, acc double, s double").select("run", curves.trend_verdict(F.col("n"), F.col("acc"), F.col("s")).alias("t")).collect()}
    assert trend == {"a": "INSUFFICIENT", "b": "HIT", "c": "FALSIFY", "d": "EXTEND", "e": "NO-GO"}


def test_atomic_rewrite(spark):
    path = new_folder(spark, "atomic")
    with pytest.raises(FileNotFoundError):
        atomic.read(spark, path)
    first = atomic.rewrite(spark.range(100), path)

    @F.udf("long")
    def dies(x):
        if x == 77:
            raise ValueError("killed midway")
        return x

    before = atomic.read(spark, path)
    with pytest.raises(Exception, match="killed midway"):
        atomic.rewrite(before.select(dies("id").alias("id")), path)
    assert atomic.current_version(spark, path) == first and atomic.read(spark, path).count() == 100
    second = atomic.rewrite(atomic.read(spark, path).where("id < 10"), path)
    assert second != first and atomic.read(spark, path).count() == 10 and before.count() == 100  # earlier readers keep theirs
    assert atomic.drop_old_versions(spark, path) >= 1 and atomic.read(spark, path).count() == 10

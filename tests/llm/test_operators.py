"""The ten operators against brute force, libraries, round trips and held-out rows, and on awkward input."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpusmill.llm import queries as Q
from corpusmill.llm.byte_bpe import bpe_decode, bpe_encode, encoder
from corpusmill.llm.chroma import _values, align, fingerprint
from corpusmill.llm.components import connected_components
from corpusmill.llm.language_id import predict_language, train_language_model
from corpusmill.llm.mixing import mix_sources, targets
from corpusmill.llm.near_dedup import near_dedup, parities
from corpusmill.llm.pitman_yor import hpy_scores, seated
from corpusmill.llm.quality_rules import DecisionList, keep_good, learn_from_labels, quality_rules, text_statistics
from corpusmill.llm.substring_dedup import substring_dedup
from corpusmill.llm.token_transducer import token_counts, transducer
from corpusmill.llm.toxicity import predict_severity, train_severity, training_rows
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, id string, body string, keep string, bucket int"
LONG = "loop word " * 30_000
AWKWARD = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v", "en", "s1", "x", "y", "z", 0),
    (2, "a b c d e f g h i j k l m n o p q r s t u w", "en", "s1", None, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "", None, None, None, None),
    (5, " \n\t ", "de", None, None, None, None, None),
    (6, "one", "en", "s2", None, None, None, None),
    (7, LONG, "en", "s2", None, None, None, None),
    (7, LONG, "en", "s2", None, None, None, None),
    (None, "null id", "en", "s1", None, None, None, None),
    (None, "null id", "en", "s1", None, None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def brute_substring(rows, k=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words, gone = (text or "").encode().split(), set()
        for s in range(len(words) - k + 1):
            key = tuple(words[s : s + k])
            if key in seen:
                gone.update(range(s, s + k))
            seen.add(key)
        out[i] = (len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone).decode())
    return out


def test_substring_dedup(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, chunk_bytes=60_000).collect()}
    assert got == brute_substring([(r.doc_id, r.text) for r in docs.collect()])


def test_substring_dedup_awkward(spark, awkward):
    rows = substring_dedup(awkward, keep=["keep", "bucket"]).collect()
    assert len(rows) == len(AWKWARD)
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[2][0].n_removed == 21 and by_id[2][0].kept_text == "w"
    assert by_id[3][0].kept_text == "" and by_id[3][0].n_words == 0
    assert sorted(r.n_removed for r in by_id[7]) == [59_998, 60_000]  # the first keeps the two words before its own repeats
    assert [(s.start, s.end) for s in by_id[2][0].spans] == [(0, 21)]
    assert substring_dedup(awkward.limit(0)).count() == 0


def test_pitman_yor_base_is_exact(spark, docs):
    training = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    rows = {r.doc_id: r for r in hpy_scores(docs, training).collect()}
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = collections.Counter(w for i in tokens if i not in held for w in tokens[i])
    total, kinds = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words), rel=1e-9)
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)
    again = {r.doc_id: r.score for r in hpy_scores(docs, training).collect()}
    assert all(again[i] == pytest.approx(rows[i].score, rel=1e-5) for i in rows)


def test_pitman_yor_probabilities_sum_to_at_most_one(spark):
    """One-word texts over a closed vocabulary: the words' chances and that of an unknown one make one."""
    words = [f"w{i}" for i in range(6)]
    rng = random.Random(1)
    train = [(i, rng.choice(words)) for i in range(300)]
    asked = [(1000 + i, w) for i, w in enumerate([*words, "unknown"])]
    df = spark.createDataFrame(train + asked, "doc_id long, text string")
    out = {r.doc_id: r for r in hpy_scores(df, F.col("doc_id") < 1000).collect()}
    alone = spark.createDataFrame(train + [(1000, "")], "doc_id long, text string")
    end_first = 10 ** hpy_scores(alone, F.col("doc_id") < 1000).where("doc_id = 1000").first().score
    # each score also holds the end after the word, which is nearly certain
    total = sum(10 ** out[i].score for i, w in asked if w != "unknown")
    assert 0.9 < total + end_first < 1.0 + 1e-6


def test_pitman_yor_awkward(spark, awkward):
    out = hpy_scores(awkward, F.lit(True))
    assert out.count() == len(AWKWARD)
    assert out.where("doc_id is null").count() == 2
    assert out.where("doc_id = 3").first().n_tokens == 1
    assert hpy_scores(awkward, F.lit(False)).where("n_known > 0").count() == 0
    assert hpy_scores(awkward.limit(0), F.lit(True)).count() == 0


def plain_hpy(train, texts, discount, sweeps=60, burn_in=20, concentration=1.0, seed=3):
    """The same model by a customer-by-customer Gibbs sampler: log10 probabilities of `texts`, averaged after burn-in."""
    rng = random.Random(seed)
    bigrams = [(w, u) for t in train for u, w in zip(["<s>", *t], [*t, "</s>"], strict=True)]
    vocabulary = {w for w, _ in bigrams}
    uniform = 1 / (len(vocabulary) + 1)
    seats = {None: collections.defaultdict(list)} | {u: collections.defaultdict(list) for _, u in bigrams}
    customers, tables = collections.Counter(), collections.Counter()

    def prob(u, w):
        below = uniform if u is None else prob(None, w)
        level = seats.get(u)
        d = discount[0] if u is None else discount[1]
        if level is None:
            return below
        own = level.get(w, [])
        return (max(sum(own) - d * len(own), 0) + (concentration + d * tables[u]) * below) / (concentration + customers[u])

    def sit(u, w):
        d = discount[0] if u is None else discount[1]
        own = seats[u][w]
        below = uniform if u is None else prob(None, w)
        fresh = (concentration + d * tables[u]) * below
        x = rng.random() * (sum(own) - d * len(own) + fresh)
        customers[u] += 1
        for k, n in enumerate(own):
            x -= n - d
            if x < 0:
                own[k] += 1
                return
        own.append(1)
        tables[u] += 1
        if u is not None:
            sit(None, w)

    def leave(u, w):
        own = seats[u][w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        customers[u] -= 1
        if not own[k]:
            own.pop(k)
            tables[u] -= 1
            if u is not None:
                leave(None, w)

    for w, u in bigrams:
        sit(u, w)
    mean = [collections.Counter() for _ in texts]
    for sweep in range(sweeps):
        for w, u in rng.sample(bigrams, len(bigrams)):
            leave(u, w)
            sit(u, w)
        if sweep >= burn_in:
            for k, t in enumerate(texts):
                for i, (u, w) in enumerate(zip(["<s>", *t], [*t, "</s>"], strict=True)):
                    mean[k][i] += prob(u, w) / (sweeps - burn_in)
    return [sum(math.log10(p) for p in m.values()) for m in mean]


def test_pitman_yor_equals_a_plain_sampler(spark):
    """Skewed words and contexts; hot words are dealt by context, as many as there are buckets for."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) ** 1.3 for i in range(40)]
    train = [rng.choices(words, weights, k=rng.randint(3, 25)) for _ in range(150)]
    asked = [rng.choices([*words, "new"], [*weights, 0.05], k=12) for _ in range(20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(train + asked)], "doc_id long, text string")
    got = [r.score for r in hpy_scores(df, F.col("doc_id") < len(train), bucket_tokens=60, sweeps=8).orderBy("doc_id").collect()]
    pairs = collections.Counter((u, w) for t in train for u, w in zip(["<s>", *t], [*t, "</s>"], strict=True))
    ones = collections.Counter(w for t in train for w in [*t, "</s>"])
    d = [min(0.95, max(0.05, a / max(1.0, a + 2 * b))) for c in (ones, pairs) for a, b in [(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()))]]
    want = plain_hpy(train, train + asked, d)
    tokens = [len(t) + 1 for t in train + asked]
    off = [abs(a - b) / n for a, b, n in zip(got, want, tokens, strict=True)]
    assert max(off) < 0.08 and sum(off) / len(off) < 0.02, (max(off), sum(off) / len(off))


def test_seating_is_that_of_customers_one_by_one():
    rng = np.random.default_rng(1)
    counts = np.array([1, 2, 7, 100, 5000, 0])
    tables = seated(counts, np.full(6, 0.5), 0.6, rng)
    assert (tables <= counts).all() and (tables[counts > 0] > 0).all() and tables[5] == 0
    for n, a, d in ((2, 0.5, 0.6), (10, 0.3, 0.5), (60, 2.0, 0.7)):
        own = []
        for _ in range(4000):
            t = 1
            for k in range(1, n):
                t += rng.random() < a / (k - d * t + a)
            own.append(t)
        assert np.mean(seated(np.full(4000, n), np.full(4000, a), d, rng)) == pytest.approx(np.mean(own), rel=0.08)


def test_chroma_finds_a_shifted_recording(spark):
    rng = np.random.default_rng(3)
    t = np.arange(6000)
    tune = sum(np.sin(2 * np.pi * f * t / 11025) * (np.sin(t / (300 + 90 * i)) > 0) for i, f in enumerate((1600, 2100, 2900, 3700, 4600)))
    clean = np.clip(128 + 20 * tune + rng.normal(0, 1, len(t)), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, 6000).astype(np.uint8)
    rows = [(20, bytearray(clean[:4000].tobytes())), (21, bytearray(clean[640:].tobytes())), (23, bytearray(other.tobytes())), (40, bytearray(b"")), (60, None), (None, bytearray(b"x"))]
    df = spark.createDataFrame(rows, "doc_id long, audio binary")
    out = {r.doc_id: r for r in align(df, F.col("doc_id") % 20 == 0).collect()}
    assert out[20].match_id == 21 and out[20].offset == -20 and out[20].error < 0.02
    assert out[40].match_id is None and out[40].copies == 2 and set(out) == {20, 40, 60}
    assert len(fingerprint(clean)) == (6000 - 128) // 32 + 1 - 7


def _best_error(p, q):
    """The smallest share of differing bits over all offsets that share half of the longer fingerprint."""
    n, m = len(p), len(q)
    out = 1.0
    for o in range(-n + 1, m):
        size = min(n - max(0, -o), m - max(0, o))
        if 2 * size >= max(n, m):
            x, y = p[max(0, -o) :][:size], q[max(0, o) :][:size]
            out = min(out, float(np.bitwise_count(x ^ y).sum()) / (32 * size))
    return out


def test_chroma_recall_against_brute_force(spark):
    """Near copies of recordings of all lengths, most of them short: production defaults find nine in ten of those a brute-force aligner finds."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for k, size in enumerate([*range(355, 545, 10), *range(560, 1500, 40), 2500, 4000]):
        text = bytearray(" ".join(rng.choice(words) for _ in range(size)).encode()[:size])
        near = bytearray(text)
        near[size // 2 : size // 2 + 6] = b"zq zxz"
        rows += [(20 * k, text), (20 * k + 1, near)]
    prints = {i: fingerprint(np.frombuffer(bytes(b), np.uint8)) for i, b in rows}
    want = {i: e for i in prints if i % 20 == 0 and not np.array_equal(prints[i], prints[i + 1]) and (e := _best_error(prints[i], prints[i + 1])) <= 0.15}
    out = {r.doc_id: r for r in align(spark.createDataFrame(rows, "doc_id long, audio binary"), F.col("doc_id") % 20 == 0).collect()}
    assert len(want) > 35 and sum(len(prints[i]) < 7 for i in want) > 10
    # The best match is the near copy, or one as good.
    assert sum(out[i].matches > 0 and out[i].error <= e + 1e-6 for i, e in want.items()) >= 0.9 * len(want)


def test_chroma_finds_both_copies_of_each_recording(spark):
    """Two planted copies, one shifted and one with 2 % of its samples changed, at production parameters."""
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(500)]
    rows = []
    for k in range(60):
        text = np.frombuffer(b" ".join(words[i] for i in rng.integers(0, 500, int(rng.integers(200, 700)))), np.uint8)
        changed = text.copy()
        at = rng.choice(len(text) // 40, max(1, len(text) // 50 // 20), replace=False)  # runs of 20 samples
        for i in at * 40:
            changed[i : i + 20] = rng.integers(97, 123, len(changed[i : i + 20]))
        rows += [(20 * k, bytearray(text.tobytes())), (20 * k + 1, bytearray(text[320:].tobytes())), (20 * k + 2, bytearray(changed.tobytes()))]
    out = align(spark.createDataFrame(rows, "doc_id long, audio binary"), F.col("doc_id") % 20 == 0).collect()
    assert len(out) == 60 and sum(r.matches >= 2 for r in out) >= 54


def test_chroma_equals_all_pairs(spark):
    """Matches and best match of every question against a plain loop over all recordings and offsets with votes."""
    rng = np.random.default_rng(10)
    base = [rng.integers(97, 123, 1500).astype(np.uint8) for _ in range(6)]
    rows = []
    for k in range(40):
        text = np.concatenate((base[k % 6][: 900 + 10 * k], base[(k + 1) % 6][: 20 * k])).copy()
        text[rng.integers(0, len(text), 3)] = 100
        rows.append((k, bytearray(text.tobytes())))
    prints = {i: fingerprint(np.frombuffer(bytes(b), np.uint8)) for i, b in rows}
    out = {r.doc_id: r for r in align(spark.createDataFrame(rows, "doc_id long, audio binary"), F.col("doc_id") % 4 == 0).collect()}
    for i, r in out.items():
        found = []
        for j, q in prints.items():
            p = prints[i]
            if i == j or np.array_equal(p, q):
                continue
            a, b = _values(p), _values(q)
            hist = collections.Counter(int(y - x) for x in range(len(a)) for y in np.flatnonzero(b == a[x]))
            if hist:
                n, o = max(((v, o) for o, v in hist.items()), key=lambda x: (x[0], -abs(x[1]), x[1]))
                x, y = p[max(0, -o) :], q[max(0, o) :]
                size = min(len(x), len(y))
                error = float(np.bitwise_count(x[:size] ^ y[:size]).sum()) / (32 * size)
                if n >= 3 and error <= 0.15:
                    found.append((round(error, 9), -n, j, o))
        assert r.matches == len(found) and (not found or (r.error, -r.votes, r.match_id, r.offset) == min(found))


def test_chroma_awkward(spark):
    tone = bytearray(bytes(range(97, 123)) * 60)
    rows = [(20, tone, "x", 1), (20, tone, "y", 2), (40, tone, None, None), (60, None, None, None), (80, bytearray(b""), None, None), (None, tone, None, None), (21, bytearray(b"zz") * 200_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, audio binary, class string, block int")
    out = align(df, F.col("doc_id") % 20 == 0).collect()
    assert sorted(r.doc_id for r in out) == [20, 20, 40, 60, 80]
    assert all(r.copies == 3 and r.class_id == 20 for r in out if r.doc_id in (20, 40)) and all(r.matches == 0 for r in out)
    assert align(df.limit(0), F.lit(True)).count() == 0


def test_toxicity_severity_is_ordered(spark):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        grade = i % 3
        rows.append((i, " ".join(rng.sample(plain, 20) + ["vile", "nasty"][:1] * (grade > 0) + ["awful", "horrid"] * (grade > 1)), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = train_severity(training_rows(df.where("doc_id % 5 <> 0"), grade=F.col("grade"), key=F.col("doc_id")), 3)
    out = predict_severity(df.where("doc_id % 5 = 0").withColumnRenamed("grade", "truth"), model).collect()
    assert np.mean([r.grade == r.truth for r in out]) > 0.95
    assert list(model.thresholds) == sorted(model.thresholds)


def test_toxicity_awkward(spark, awkward):
    assert predict_severity(awkward, None).where("severity = 0").count() == len(AWKWARD)
    assert train_severity(training_rows(awkward.limit(0), grade=F.lit(1), key=F.col("doc_id")), 3) is None


TIKTOKEN = public_tokenizers.path("byte_bpe_50k.tiktoken")


def fuzz(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdersvltm'  thein\n\t'éüß漢字🙂0123٣.,!# \u0085\x1c") for _ in range(rng.choice([3, 30, 700]))) for _ in range(n)] + ["", "a" * 3000, " " * 900 + "x", "'re're'r'v'll'l", "x\n\n  y", "<|endoftext|>a<|endoftext|>"]


def test_bpe_equals_the_library(spark, docs):
    import tiktoken

    tool = encoder(TIKTOKEN, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tool.ranks.rank, special_tokens={})
    texts = [r.text for r in docs.select("text").collect()] + fuzz(300)
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    for r in bpe_encode(df, TIKTOKEN, public_tokenizers.PATTERN, decoded_col="decoded").collect():
        assert r.ids == library.encode_ordinary(r.text) and bytes(r.decoded) == r.text.encode()
    assert tool.encode(texts[0]) == library.encode_ordinary(texts[0])


def test_bpe_awkward(spark, awkward):
    out = bpe_encode(awkward, TIKTOKEN, public_tokenizers.PATTERN, ids_col="bucket")
    assert out.count() == len(AWKWARD) and out.where("text is null").first().bucket == []
    assert set(out.columns) == set(awkward.columns)
    back = bpe_decode(out, TIKTOKEN, public_tokenizers.PATTERN, ids_col="bucket").where("text is not null")
    assert all(bytes(r.decoded).decode() == r.text for r in back.collect())
    assert bpe_encode(awkward.limit(0), TIKTOKEN, public_tokenizers.PATTERN).count() == 0


def brute_statistics(text):
    words = [w.decode() for w in (text or "").encode().split()]
    at = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    mark = [False] * len(words)
    for i in range(len(words) - 4):
        if at[tuple(words[i : i + 5])] > 1:
            mark[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(mark)


def test_quality_statistics(spark, docs, awkward):
    for df in (docs, awkward):
        rows = text_statistics(df, whole_row="r").collect()
        assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(r.r.text) for r in rows)
        assert len(rows) == df.count()


def test_quality_rules_learn_a_planted_rule(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["###"] * (5 if i % 4 == 0 else 0) + [rng.choice("abcdefgh") * 2 + rng.choice("xyz") for _ in range(35 if i % 4 == 0 else 40)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 0), (1, None)], "doc_id long, quality int")
    out, rules = quality_rules(docs, labels)
    assert rules.rules and rules.rules[0][0][0] == "symbols"
    assert out.where("not base_failed and kept <> (doc_id % 4 <> 0)").count() == 0
    kept = keep_good(docs, rules)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_rules_awkward(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out, rules = quality_rules(awkward, none)
    assert rules == DecisionList() and out.count() == len(AWKWARD)
    assert out.where("doc_id = 3").first().base_failed
    assert learn_from_labels(awkward.limit(0), none).rules == []


def test_transducer_equals_the_library(spark, docs, awkward):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [r.text for r in docs.select("text").collect()] + fuzz(300, 4) + ["y" * 5000, "a b " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    got = {r.n: r.n_tokens for r in token_counts(df, path).collect()}
    assert [got[i] for i in range(len(texts))] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    out = token_counts(awkward, path, out_col="bucket")
    assert out.count() == len(AWKWARD) and out.where("text is null").first().bucket == 0
    assert token_counts(awkward.limit(0), path).count() == 0


def test_transducer_survives_a_full_table():
    machine, _ = transducer(public_tokenizers.path("byte_bpe_50k.json"))
    before = machine.counts([b"some words of text", b"more"]).tolist()
    machine.clear()
    assert machine.counts([b"some words of text", b"more"]).tolist() == before


def test_language_id(spark, docs, awkward):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train_language_model(docs.where(~held), key=F.col("doc_id"))
    out = predict_language(docs.where(held), model)
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    assert out.where("score between 0 and 1").count() == out.count()
    odd = predict_language(awkward, model)
    assert {r.doc_id for r in odd.where("lang_pred = 'und'").collect()} == {3, 4, 5}
    assert train_language_model(docs.limit(0)) is None
    assert predict_language(awkward, None).where("lang_pred <> 'und'").count() == 0


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_targets(spark):
    for sizes in ({"a": 100, "b": 10, "c": 1, None: 1000}, {"a": 5, "b": 5, "c": 5}, {"b": 1, "c": 300, "a": 7, "Z": 4}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in targets(df, (1, 2, 3), 3.0).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mixing(spark, docs, awkward):
    out = mix_sources(docs, block_rows=40)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
    assert collections.Counter(out.collect()) == collections.Counter(mix_sources(docs.repartition(7), block_rows=40).collect())
    odd = mix_sources(awkward)
    assert odd.count() == len(AWKWARD) and odd.where("taken > 3 * size").count() == 0
    assert mix_sources(awkward.limit(0)).count() == 0


def brute_components(rows, width, percent=80):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = frozenset(zip(*[words[k:] for k in range(width)], strict=False)) if len(words) >= width else frozenset([tuple(words)] if words else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sorted(sets) if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, docs, width):
    rng = random.Random(6)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = rows[1][1].split()[:120]
    for i in range(60):  # one dense group of near copies around the threshold
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(base)
        rows.append((10_000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(df, width=width, region_rows=8).collect()}
    assert got == brute_components(rows, width)


def test_near_dedup_awkward(spark, awkward):
    rows = near_dedup(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.kept and r.component_id == r.doc_id for r in rows if r.doc_id in (3, 4, 5))
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dedup(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1 << 15, 20, 1])
def test_components(spark, block):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "x long, y long"), "x", "y", block=block).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[300] == 100 and got[549] == 500 and len(got) == 40 + 3 + 50


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - {"op11_prefix_trie", "op12_vector_codes"}))
def test_query_gives_each_document_once(spark, sf_dir, docs, name):
    out = Q.QUERIES[name](spark, sf_dir)
    want = docs.where("doc_id % 20 = 0").count() if name == "op3_chroma" else docs.count()
    assert out.count() == want == out.select("doc_id").distinct().count()


def test_op5_digests(spark, sf_dir, docs):
    tool = encoder(TIKTOKEN, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.op5_byte_bpe(spark, sf_dir).limit(40).collect():
        ids = tool.encode(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as P

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in rows.collect()}
    for name, stage in P.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, sf_dir).collect(), docs.schema)
        now = {r.doc_id for r in rows.collect()}
        assert now <= ids, name
        ids = now
    last = P.STAGES[-1][1](spark, rows, sf_dir)
    assert last.count() == rows.count() and last.where("not decodes").count() == 0
    assert P.run(spark, sf_dir).count() == last.count()


def test_substring_dedup_wide_and_repeated_ids(spark):
    """62-bit hashed ids over many chunks, the largest ids there are, and one id in half of all rows."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows = [(rng.getrandbits(62), " ".join(rng.choice(words) for _ in range(25)) + (f" {passage}" if i % 9 == 0 else "")) for i in range(600)]
    rows += [(2**63 - 1, f"{passage} end"), (2**63 - 2, passage), (-(2**63), f"start {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, chunk_bytes=64).collect()}
    assert got == brute_substring(rows)
    many = spark.createDataFrame([(5, f"{passage} {i}") for i in range(300)] + rows[:300], "doc_id long, text string")
    out = substring_dedup(many, chunk_bytes=500).where("doc_id = 5").collect()
    assert len(out) == 300 and sum(r.n_removed == 0 for r in out) == 1


def test_near_dedup_does_not_depend_on_row_order(spark):
    """An id with two texts links with the copies of either."""
    base = [f"a{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (5, " ".join(f"b{i}" for i in range(60))), (6, " ".join([*base[:-1], "x"])), (7, " ".join([*(f"b{i}" for i in range(59)), "x"])), (8, "other text of some words that stand alone")]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = [(r.doc_id, r.component_id) for r in near_dedup(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), width=2).collect()]
        assert sorted(got) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


@pytest.mark.parametrize("seed", [11, 12])
def test_near_dedup_recall_in_dense_groups(spark, seed):
    """Families of near copies just around the threshold: components equal those of all pairs."""
    rng = random.Random(seed)
    rows = []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(80):
            words = list(base)
            for _ in range(rng.randint(0, 16)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    want = brute_components(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=2, region_rows=64).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    print("equal", sum(got[i] == want[i] for i in want), "of", len(want), "components", len({v[1] for v in want.values()}))


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 40, 900, 20000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 4 // 5], rng.integers(0, 2**63, n // 3, dtype=np.uint64)]))
        p, q = parities([a, b])
        differ = int(np.bitwise_count(p ^ q).sum())
        assert differ <= len(np.setxor1d(a, b))
        assert n > 40 or differ >= 0.7 * len(np.setxor1d(a, b))
    assert not parities([np.zeros(0, np.uint64)]).any()

"""Prefix tries, vector codes and token files against brute force and the tokenizer library, and on awkward input."""

import collections
import hashlib
import random
import zlib

import numpy as np
import oracle
import public_tokenizers
import pytest
from corpusmill.llm import prefix_trie as P
from corpusmill.llm import queries as Q
from corpusmill.llm.common import shared_folder
from corpusmill.llm.token_files import WordEncoder, file_documents, token_counts_in, token_places, write_token_files
from corpusmill.llm.vector_codes import codebooks_text, nearest, neighbours, vector_codes
from corpusmill.llm.wavelet import BLOCK, WaveletMatrix, pack

WORDS = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn int, role string, text string, depth int, k0 string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    saved, leaves = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
            leaves[k[:d]] += not kids[k]
    ends = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        ends[tuple(turns)].append(c)
    digest = {k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest() for k in members}
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], digest[k]) for k, m in members.items())


def trie(spark, rows):
    turns, lengths = P.with_shared_heads(P.numbered(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)), 5, 9)
    return sorted(map(tuple, P.prefix_trie(turns, lengths).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("block", [2, 4096])
def test_prefix_trie(spark, monkeypatch, block):
    """Small blocks make every conversation and path span several."""
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for c in rng.sample(range(200), 90):
        for t in range(rng.choice([1, 2, 5, 12])):
            rows.append((c, t, rng.choice("ua"), rng.choice(["yes", "no", "ä" * 5])))
    rows += [(1000 + i, t, "u", "same") for i in range(30) for t in range(15)]  # many copies of one long conversation
    rows += [(2000, None, None, None), (2000, 3, "u", None), (2001, 1, None, "long " * 20_000), (None, 1, "u", "nobody")]
    assert trie(spark, rows) == brute_trie(rows)


def test_prefix_trie_repeats_ties_and_nothing(spark):
    assert trie(spark, []) == []
    twice = [(10, 1, "u", "a"), (10, 1, "u", "a"), (10, 2, "u", "b")]
    assert trie(spark, twice) == brute_trie(twice)
    tied = [(10, 1, "u", "a"), (10, 1, "u", "b"), (15, 1, "u", "b"), (15, 1, "u", "a")]
    assert len(trie(spark, tied)) == 3  # equal turns have one order, whatever the rows' order
    gone = [(5 * k + 4, 1, "u", "a") for k in range(40)]
    got = trie(spark, gone)
    assert got == brute_trie(gone) and got[0][7] != hashlib.sha256(b"").hexdigest()  # some are rebuilt without turns and end at the root


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_vector_codes"])
def test_query_equals_its_sql(spark, sf_dir, name):
    assert oracle.difference(spark, oracle.connect(sf_dir), Q.QUERIES[name], Q.ORACLE_SQL[name], sf_dir) == ""


def brute_codes(rows, parts=4, entries=256, rounds=4):
    fine = [(i, label, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fine.sort(key=lambda r: r[0])
    size = len(fine[0][2]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, _, v in fine]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min(((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p]))) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                if own := [c[p] for c, a in zip(cut, at, strict=True) if a[p][1] == k]:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    error = [sum(g for g, _ in a) for a in at]
    by_label = collections.Counter()
    for (_, label, _), e in zip(fine, error, strict=True):
        by_label[label] += e
    out = sorted((i, "".join(f"{k:02x}" for _, k in a), e, by_label[label]) for (i, label, _), a, e in zip(fine, at, error, strict=True))
    return out, ",".join(str(x) for p in books for e in p for x in e)


@pytest.mark.parametrize("entries", [3, 8])
def test_vector_codes(spark, entries):
    rng = np.random.default_rng(entries)
    rows = [(i, int(i % 3) if i % 7 else None, rng.integers(-3, 4, 8).astype(float).tolist() if i % 2 else rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100, 1, rows[1][2]), (101, None, rows[1][2])]  # ties and repeated vectors
    bad = [(-5, 1, None), (-4, 1, [None] * 8), (-3, 1, [float("nan")] * 8), (-2, 1, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, label int, embedding array<float>, codes string").repartition(3)
    out, books = vector_codes(df, entries=entries)
    got = sorted((r.vec_id, r.codes.hex(), r.error, r.label_error) for r in out.collect())
    want, text = brute_codes(rows, entries=entries)
    assert got == want and codebooks_text(books) == text


def test_vector_codes_awkward(spark):
    schema = "vec_id long, label int, embedding array<float>"
    out, books = vector_codes(spark.createDataFrame([], schema))
    assert out.collect() == [] and books.size == 0
    rows = [(1, None, [0.5] * 4), (2, None, [0.5] * 4), (2, None, [0.5] * 4), (None, 3, [1.0] * 4), (4, 1, [1.0] * 8), (5, 1, [])]
    out, books = vector_codes(spark.createDataFrame(rows, schema))
    assert sorted((r.vec_id or 0, r.label, r.error) for r in out.collect()) == [(0, 3, 0), (1, None, 0), (2, None, 0), (2, None, 0)] and books.shape == (4, 4, 1)
    with pytest.raises(Exception, match="no exact 64-bit"):
        vector_codes(spark.createDataFrame([(1, 1, [3e30] * 4)], schema))[0].collect()


@pytest.mark.parametrize("most", [50, 1 << 24])
def test_nearest_is_exact(most):
    rng = np.random.default_rng(most)
    x, book = rng.integers(-most, most, (500, 4)), rng.integers(-most, most, (40, 4))
    book[7] = book[3]
    gaps = ((x[:, None] - book[None]) ** 2).sum(-1)
    found, gap = nearest(x, book, rng.integers(0, 40, 500).astype(np.uint8), neighbours(book))
    assert found.tolist() == gaps.argmin(1).tolist() and gap.tolist() == gaps.min(1).tolist()


@pytest.mark.parametrize(("n", "kinds"), [(0, 1), (1, 1), (5, 1), (100, 2), (2 * BLOCK, 3), (BLOCK + 77, 49_408), (3 * BLOCK - 1, 70_000)])
def test_wavelet_matrix(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), kinds).astype(np.uint32)
    m = WaveletMatrix(pack(ids) + b"\n")
    assert m.all().tolist() == ids.tolist()
    some = rng.integers(0, n, 40) if n else np.zeros(0, np.int64)
    assert m.take(some).tolist() == ids[some].tolist()
    for t in {*ids[:6].tolist(), 0, kinds, kinds + 1}:
        assert m.occurrences(t).tolist() == np.flatnonzero(ids == t).tolist()
        assert m.count(t) == (ids == t).sum() and m.count(t, n // 3, n // 2) == (ids[n // 3 : n // 2] == t).sum()


ODD = ["", "  ", "it's CAN'T. o'clock, don't", "naïve Straße ΣΑΣ J̌ é", "a\x1cb c\x85d e\xa0f g", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "... ., a. b, c.. d.,e 123 4a b5 .a", "日本語 テスト 你好。", "á x́. ́ ́b", "👩‍👩‍👧 a😀b", "\x00a \x0bb\x0c"]


def library(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 2] for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_is_the_library(monkeypatch):
    from corpusmill.llm import token_files

    monkeypatch.setattr(token_files, "MEMO_WORDS", 20)
    tool = WordEncoder(WORDS)
    for texts in (ODD, ODD[::-1], ["word " * 50_000]):
        ids, sizes = tool.encode([t.encode() for t in texts], 2)
        want = library(texts)
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


def test_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (None, "null id"), (-2, "twice"), (-2, "twice"), *[(-10 - i, t) for i, t in enumerate(ODD)]], "doc_id long, text string")
    every = docs.unionByName(odd).selectExpr("doc_id", "text", "1 AS start", "text AS file")
    folder = shared_folder(spark, "tokens")
    write_token_files(every, folder, WORDS, shard_ids=3000, partitions=5)
    rows = sorted(map(tuple, every.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids, at, want = library([t or "" for _, t in rows]), 0, []
    for (doc, _), own in zip(rows, ids, strict=True):
        want.append((doc, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    got = file_documents(spark, folder).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert spark.read.format("binaryFile").load(folder).count() > 10
    common = collections.Counter(i for own in ids for i in own).most_common(2)
    tokens = [common[0][0], common[1][0], 49_000]
    counted = {r.token: r.occurrences for r in token_counts_in(spark, folder, tokens).collect()}
    assert counted == {t: sum(own.count(t) for own in ids) for t in tokens}
    places = collections.Counter(map(tuple, token_places(spark, folder, tokens[1:]).collect()))
    assert places == collections.Counter((t, doc, i) for t in tokens[1:] for (doc, _), own in zip(rows, ids, strict=True) for i, x in enumerate(own) if x == t)


def test_token_files_of_nothing(spark):
    folder = shared_folder(spark, "tokens")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, WORDS)
    assert file_documents(spark, folder).collect() == []

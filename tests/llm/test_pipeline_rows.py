"""Stages of the pipeline on awkward rows: repeated and null ids, nulls, no rows, and columns whose names clash."""

import collections

import corpus_pipeline as C
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, m_id long, m_source string, copies int, row string, size long"


def text(word, n=60):
    return " ".join(f"{word}{i}" for i in range(n))


@pytest.fixture(scope="module")
def rows(spark):
    own = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("a")), (3, text("c")), (4, None), (5, ""), (None, text("d")), (None, text("d")), (6, text("c", 59))]
    return spark.createDataFrame([(i, t, "en", "s1" if i else None, 0, 7, "x", 9, "r", 1) for i, t in own], SCHEMA)


def test_near_duplicates_keep_each_text_of_an_id(spark, rows):
    kept = C.near_duplicates(spark, rows, "").select("doc_id", "text").collect()
    want = [(1, text("a")), (1, text("b")), (3, text("c")), (4, None), (5, ""), (None, text("d")), (None, text("d"))]
    assert collections.Counter(map(tuple, kept)) == collections.Counter(want)
    assert C.near_duplicates(spark, rows.limit(0), "").collect() == []


def test_mixture_of_clashing_columns(spark, rows):
    out = C.mixture(spark, rows, "")
    assert out.columns == rows.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got and max(got.values()) <= 6 and not any(t in (None, "") for _, t in got)
    assert set(got) <= {(r.doc_id, r.text) for r in rows.collect()}
    assert C.mixture(spark, rows.limit(0), "").collect() == []


def test_passages_and_encoding(spark, rows):
    cut = C.repeated_passages(spark, rows, "")
    assert cut.count() == rows.count()
    ids = C.encode(spark, rows, "").collect()
    assert len(ids) == rows.count() and all(r.decodes for r in ids) and {r.n_tokens for r in ids if r.doc_id in (4, 5)} == {0}

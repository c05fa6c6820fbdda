"""Position logic on small texts and sequences."""

import pytest
from corpusmill.functions import spans as S
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_affixes_put_both_together_again(a, b):
    s, i, j = S.affix_difference(a, b)
    assert a[:s] + b[s:j] + a[i:] == b and s <= i <= len(a)


@given(st.lists(st.integers(0, 3), max_size=12))
def test_no_changes_between_equals(a):
    assert S.changes(a, list(a)) == []


@given(st.text("ab\n ", max_size=80), st.integers(3, 20))
def test_chunks_lose_no_words(text, size):
    assert "".join("".join(S.chunks(text, size)).split()) == "".join(text.split())
    assert all(len(x) <= size for x in S.chunks(text, size))


@pytest.mark.parametrize("answer, want", [("red fox", "red fox"), ("a quick red fox here", "quick red fox"), ("none of it", None)])
def test_literal_span(answer, want):
    assert S.literal_span(answer, "the quick red fox ran") == want


@pytest.mark.parametrize("text, want", [("x = 1", True), ("df <- read.csv(f)", True), ("plain words here", False), ("", False)])
def test_code(text, want):
    assert S.is_code(text) is want


def test_titles_and_arguments():
    assert S.title_form("Ñandú: a  Stüdy!") == "nandu a study"
    assert S.arguments_match("Quercus robur", "quercus ROBUR L.") and not S.arguments_match("oak", "pine")


def test_front_matter():
    text = "A\njournal information\nAbstract\nbody"
    assert S.front_matter(text) == "Abstract\nbody" and S.front_matter("no heading") == "no heading"


def test_markdown_body():
    text = "# Index\n12\n# Chapter\n" + "real prose goes here. " * 10 + "\n## References\nx"
    assert S.markdown_body(text).startswith("# Chapter") and "References" not in S.markdown_body(text)


def test_numbers_before_nouns():
    assert S.number_before_noun("we saw 12 large herons", ["heron"]) and not S.number_before_noun("herons 12", ["heron"])


def test_response_spans():
    ids, spans = S.response_spans([([1, 2], False), ([3, 4], True)], 9, 10)
    assert ids == [1, 2, 3, 4, 9] and spans == [(2, 5)]
    assert S.response_spans([([1, 2, 3], False), ([4], True)], 9, 3) == ([], [])
    assert S.find_run([1, 2, 3, 2, 3], [2, 3], 2) == 3 and S.find_run([1], []) == -1


def test_inferable():
    assert S.inferable("it is so", "it is not so", "") == "negation"
    assert S.inferable("grew 5 m", "grew 15 m", "a rise of 5 m") == "number"
    assert S.inferable("red fox", "blue fox", "the red one") == "context word"
    assert S.inferable("red fox", "blue fox", "nothing") == "provenance"


def test_columns(spark):
    df = spark.createDataFrame([("Therefore 5 rivers",), (None,)], "t string")
    got = df.select(S.udf(S.title_form, "string")("t").alias("f"), S.role_scores(F.split("t", " ")).alias("r")).collect()
    assert got[0].f == "therefore 5 rivers" and got[0].r == [4.5, 3.0, 1.0] and got[1].f is None


def test_role_scores(spark):
    words = F.split(F.lit("the Panthera NASA 12% Therefore 3x"), " ")
    got = spark.range(1).select(S.role_scores(words, ("panthera",)).alias("r")).first().r
    assert got == [1.0, 3.5, 1.0, 3.0, 4.5, 1.0]

"""Files of other kinds, and prompts and sections, on small fixtures."""

import gzip
import io
import json
import tarfile

import numpy as np
import pytest
from corpusmill.functions import prompts
from corpusmill.sources import files
from pyspark.sql import functions as F


def test_token_caches(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(10, dtype=np.int32))
    np.save(tmp_path / "b.npy", np.zeros(0, np.uint16))
    (tmp_path / "c.txt").write_text("not a cache")
    got = {(r.path.rsplit("/", 1)[1], r.part): r.ids for r in files.token_caches(spark, str(tmp_path), chunk=4).collect()}
    assert got == {("a.npy", 0): [0, 1, 2, 3], ("a.npy", 1): [4, 5, 6, 7], ("a.npy", 2): [8, 9]}
    np.save(tmp_path / "d.npy", np.ones((2, 2)))
    with pytest.raises(Exception, match="no flat array"):
        files.token_caches(spark, str(tmp_path)).collect()


def test_metric_reports(spark, tmp_path):
    for name, text in {"base-s1_L0.json": json.dumps({"acc": 0.5, "n": 10}), "base-s2_L3.json": json.dumps({"acc": 0.7}), "other.json": "{}", "base-s3_L1.json": "{broken"}.items():
        (tmp_path / name).write_text(text)
    got = sorted(tuple(r) for r in files.metric_reports(spark, f"{tmp_path}/*.json", "acc double, n long", r"/(\w+)-s(\d+)_L(\d)\.json$", ["run", "seed", "level"]).collect())
    assert got == [("base", "1", "0", 0.5, 10), ("base", "2", "3", 0.7, None)]


def test_latex_sources(spark, tmp_path):
    def archive(members, mode):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as t:
            for name, text in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(data := text.encode())
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    for name, data in {"a.tar.gz": archive({"x.tex": "short", "d/y.tex": "the longer source é", "z.png": "p" * 99}, "w:gz"), "b.tar": archive({"only.png": "p"}, "w"), "c.gz": gzip.compress(b"plain \xff text"), "d.gz": gzip.compress(b"cut off")[:12]}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.member, r.text) for r in files.latex_sources(spark, str(tmp_path)).collect()}
    assert got == {"a.tar.gz": ("d/y.tex", "the longer source é"), "b.tar": (None, None), "c.gz": (None, "plain � text"), "d.gz": (None, None)}


def first(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_prompts(spark):
    text = "a [ACT] b \n[ACT] {c} \n"
    assert tuple(first(spark, prompts.split_at_last(F.col("t"), "[ACT]", "response"), t=text)) == ("a [ACT] b", "[ACT] {c}")
    assert tuple(first(spark, prompts.split_at_last(F.col("t"), "[ACT]", "prompt"), t=text)) == ("a [ACT] b \n[ACT]", "{c}")
    assert tuple(first(spark, prompts.split_at_last(F.col("t"), "[ACT]", "prompt"), t="none")) == (None, None)
    assert first(spark, prompts.explanation(F.col("t"), 20), t="One. Two three. Four five") == "One. Two three."
    assert first(spark, prompts.explanation(F.col("t"), 8), t="no full stop here") == "no full "
    assert first(spark, prompts.explained(F.lit("Oxygen"), F.col("t")), t="It is oxygen. Plants make it") == "It is oxygen."
    assert first(spark, prompts.explained(F.lit("Iron"), F.col("t")), t="Rust is red. So") == "Iron. Rust is red."
    got = first(spark, prompts.sections(F.col("t"), ["CONTEXT", "CODE"]), t="x [context] why\nso [CODE]\nprint(1) ")
    assert got.context == "why\nso" and got.code == "print(1)"
    assert first(spark, prompts.sections(F.col("t"), ["A", "B"]), t="[A]  [B]x").asDict() == {"a": None, "b": "x"}
    assert first(spark, F.concat_ws("|", *prompts.tail_and_head(F.lit("a b c d"), F.col("t"), 2, 3)), t="e f") == "c|d|e|f"
    assert first(spark, prompts.word_language(F.col("t"), ["el", "de"], ["the"]), t="the sol de España") == "es"
    assert first(spark, prompts.word_language(F.col("t"), ["el"], ["the"]), t="el the") == "en"

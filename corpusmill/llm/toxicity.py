"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words and the first five bytes of each (so
that inflected forms share one), hashed to `2**bits`.  One weight vector serves
all thresholds: P(grade <= k) = sigmoid(threshold_k - w.x) with ascending
thresholds, and the expected severity is the sum of P(grade > k).  Weights are
learned per coordinate with a proximal step, so that L1 keeps most of them at
zero; blocks of the training rows run from the same state in each round and are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .wordhash import BASE_BYTES, SPACE, mix, powers, prefix_sums, runs

RUN_BYTES, PREFIX = 1 << 20, 5
#: ASCII letters in lower case, other ASCII as space, the rest as it is.
LETTERS = bytes((b | 32) if 65 <= b <= 90 or 97 <= b <= 122 else b if b >= 128 else 32 for b in range(256))


def features(texts: list[bytes], bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts [a, b): the distinct features of each text, and where each text's begin."""
    for a, b in runs([len(t) for t in texts], RUN_BYTES):
        data = np.frombuffer(b"\n".join(texts[a:b]).translate(LETTERS) + b" ", np.uint8)
        edge = np.diff(np.concatenate(([True], SPACE[data])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = powers(BASE_BYTES, len(data) + 1)
        sums = prefix_sums(data.astype(np.uint64) + np.uint64(1), down)
        text_ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        owner = np.searchsorted(text_ends, starts, side="right").astype(np.uint64) << np.uint64(bits)
        keys = [owner | (mix((sums[e] - sums[starts]) * up[starts], s) >> np.uint64(64 - bits)) for s, e in ((1, ends), (2, np.minimum(ends, starts + PREFIX)))]
        keys = np.unique(np.concatenate(keys))
        yield a, b, (keys & np.uint64((1 << bits) - 1)).astype(np.int32), np.searchsorted(keys >> np.uint64(bits), np.arange(b - a + 1, dtype=np.uint64))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class SeverityModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for each text and threshold k."""
        score = np.zeros(len(texts))
        for a, b, feature, starts in features(texts, self.bits):
            score[a:b] = np.bincount(np.repeat(np.arange(b - a), np.diff(starts)), self.weights[feature], b - a)
        return 1 - _sigmoid(self.thresholds[None] - score[:, None])


def training_rows(labelled: DataFrame, *, text_col: str = "text", grade: Column, key: Column, bits: int = 18, max_rows: int = 20_000, blocks: int = 8) -> DataFrame:
    """Features of a bounded sample of labelled rows: `max_rows` at most or so, chosen by the hash of `key`, dealt into blocks."""
    rows = labelled.select(F.coalesce(text_col, F.lit("")).alias("t"), grade.cast("int").alias("grade"), F.xxhash64(key).alias("h")).where("grade is not null")
    share = min(1.0, max_rows / max(1, rows.count()))
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            grade, block, h = part["grade"].tolist(), part["block"].tolist(), part["h"].tolist()
            for a, b, feature, starts in features([t.encode() for t in part["t"]], bits):
                yield pd.DataFrame([(block[a + i], h[a + i], grade[a + i], feature[starts[i] : starts[i + 1]].tobytes()) for i in range(b - a)], columns=["block", "h", "grade", "feature"])

    return checkpointed(sample.mapInPandas(extract, "block long, h long, grade int, feature binary").repartition(blocks, "block"))


def train_severity(rows: DataFrame, grades: int, *, bits: int = 18, rounds: int = 8, alpha: float = 0.12, l1: float = 0.5) -> SeverityModel | None:
    """Fit on `training_rows`.  None if fewer than two grades occur."""
    if rows.select("grade").distinct().limit(2).count() < 2:
        return None
    size, sc = 1 << bits, rows.sparkSession.sparkContext
    z, n, cuts = np.zeros(size), np.zeros(size), np.linspace(1, 2, grades - 1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) * alpha / (1 + np.sqrt(n)), 0.0)

    for r in range(rounds):
        rate = 0.05 / (1 + r)
        state = sc.broadcast((z.astype(np.float32), n.astype(np.float32), cuts))  # as large as the model

        def leader(part: pd.DataFrame) -> tuple[bytes, bytes, bytes]:
            z, n, cuts = (v.astype(np.float64) for v in state.value)
            part = part.sort_values("h")
            for y, f in zip(part["grade"], part["feature"], strict=True):
                f = np.frombuffer(f, np.int32)
                w = weights(z[f], n[f])
                s = _sigmoid(cuts - w.sum())
                high, low = (s[y] if y < grades - 1 else 1.0), (s[y - 1] if y else 0.0)
                p = max(high - low, 1e-9)
                g = 1 - high - low
                more = n[f] + g * g
                z[f] += g - (np.sqrt(more) - np.sqrt(n[f])) / alpha * w
                n[f] = more
                if y < grades - 1:
                    cuts[y] += rate * high * (1 - high) / p
                if y:
                    cuts[y - 1] -= rate * low * (1 - low) / p
                cuts = np.maximum.accumulate(cuts)
            return z.astype(np.float32).tobytes(), n.astype(np.float32).tobytes(), cuts.tobytes()

        def leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The rows of a block lie in one partition, so nothing moves between rounds."""
            parts = [p for p in batches if len(p)]
            for _, part in pd.concat(parts).groupby("block") if parts else []:
                yield pd.DataFrame([(0, *leader(part))], columns=["all", "z", "n", "cuts"])

        def mean(states: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[np.mean([np.frombuffer(b, kind) for b in states[k]], axis=0).astype(kind).tobytes() for k, kind in (("z", np.float32), ("n", np.float32), ("cuts", np.float64))]], columns=["z", "n", "cuts"])

        got = rows.mapInPandas(leaders, "all int, z binary, n binary, cuts binary").groupBy("all").applyInPandas(mean, "z binary, n binary, cuts binary").first()
        z, n, cuts = np.frombuffer(got["z"], np.float32), np.frombuffer(got["n"], np.float32), np.frombuffer(got["cuts"])
        state.destroy()
    return SeverityModel(weights(z, n).astype(np.float32), cuts, bits)


def split_grades(rows: DataFrame, model: SeverityModel, grades: int) -> DataFrame:
    """Divide grade 1 of binary rows into `grades` - 1 equal parts by the score of a model fitted on them."""
    w = rows.sparkSession.sparkContext.broadcast(model.weights)  # 2**bits numbers

    @F.pandas_udf("double")
    def score(feature: pd.Series) -> pd.Series:
        return feature.map(lambda f: float(w.value[np.frombuffer(f, np.int32)].sum())).astype("float64")

    scored = checkpointed(rows.withColumn("score", score("feature")))
    cuts = scored.where("grade = 1").agg(F.percentile_approx("score", [i / (grades - 1) for i in range(1, grades - 1)])).first()[0] or []
    grade = F.lit(1)
    for c in cuts:
        grade = grade + F.when(F.col("score") > c, 1).otherwise(0)
    return scored.withColumn("grade", F.when(F.col("grade") == 1, grade).otherwise(0).cast("int"))


def predict_severity(docs: DataFrame, model: SeverityModel | None, *, text_col: str = "text") -> DataFrame:
    """Add `severity` (expected grade) and `grade` (the last threshold passed with probability over 1/2).

    Whole texts are read.  Null and empty texts score as texts without features; without a model
    all is 0.  Other columns pass; those of the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<severity:double,grade:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            if shared.value is None:
                yield pd.DataFrame({"severity": np.zeros(len(column)), "grade": 0})
                continue
            above = shared.value.above([(t or "").encode() for t in column])
            yield pd.DataFrame({"severity": above.sum(1), "grade": (above > 0.5).sum(1)})

    out = docs.withColumn("__severity", run(F.col(text_col)))
    return out.withColumn("severity", F.col("__severity.severity")).withColumn("grade", F.col("__severity.grade")).drop("__severity")


def flag_toxic(scored: DataFrame, clean: DataFrame, *, id_col: str = "doc_id", quantile: float = 0.999) -> DataFrame:
    """Add `toxic`: a severity above the given quantile of the rows known to be clean, and above 0.05."""
    cut = scored.join(clean, id_col, "left_semi").agg(F.percentile_approx("severity", quantile, 10000)).first()[0] or 0.0
    return scored.withColumn("toxic", F.col("severity") > max(0.05, cut))

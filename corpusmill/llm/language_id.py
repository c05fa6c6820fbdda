"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Letters are lower-cased and everything else becomes a space; the distinct 2- and
3-grams of a text, hashed to `2**bits` features, weigh (1 + log count) * idf,
scaled to unit length.  Training is follow-the-regularised-leader (proximal, per
coordinate) with an elastic-net penalty, so most weights are exactly zero.  Each
round runs it over blocks of the training rows from the same state, and the
states are averaged; they are as large as the model, whatever the corpus.  A
temperature fitted on rows that were not trained on calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .pieces import LETTER, classes
from .wordhash import mix, runs

RUN_CHARS = 1 << 20
TEMPERATURES = np.exp(np.linspace(np.log(0.2), np.log(5), 60))
_lower: list[np.ndarray] = []


def lower_letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space."""
    if not _lower:
        table = np.full(0x110000, 32, np.uint32)
        for c in np.flatnonzero(classes() == LETTER).tolist():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
        _lower.append(table)
    return _lower[0]


def features(texts: list[str], bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts [a, b): feature of each (text, feature) pair, its count, where each text's pairs start, and whether it has letters."""
    lower = lower_letters()
    for a, b in runs([len(t) for t in texts], RUN_CHARS):
        sizes = np.array([len(t) + 2 for t in texts[a:b]])
        points = lower[np.frombuffer((" " + "  ".join(texts[a:b]) + " ").encode("utf-32-le"), np.uint32)].astype(np.uint64)
        ends = np.cumsum(sizes)
        text_of = np.repeat(np.arange(b - a), sizes)
        letters = np.add.reduceat(points != 32, ends - sizes) > 0
        keys = []
        for n in (2, 3):
            h = np.zeros(len(points) - n + 1, np.uint64)
            blank = np.ones(len(h), bool)
            for k in range(n):
                h = (h << np.uint64(21)) | points[k : len(points) - n + 1 + k]
                blank &= points[k : len(points) - n + 1 + k] == 32
            fine = (text_of[: len(h)] == text_of[n - 1 :]) & ~blank
            keys.append((text_of[: len(h)][fine].astype(np.uint64) << np.uint64(bits)) | (mix(h[fine], n) >> np.uint64(64 - bits)))
        keys = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        pairs = keys[first]
        starts = np.searchsorted(pairs >> np.uint64(bits), np.arange(b - a + 1, dtype=np.uint64))
        yield a, b, (pairs & np.uint64((1 << bits) - 1)).astype(np.int32), counts, starts, letters


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # features x languages
    idf: np.ndarray
    temperature: float
    bits: int

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, known = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        for a, b, feature, counts, starts, letters in features(texts, self.bits):
            x = (1 + np.log(counts)) * self.idf[feature]
            text_of = np.repeat(np.arange(b - a), np.diff(starts))
            norm = np.sqrt(np.bincount(text_of, x * x, b - a))
            scale = 1 / np.where(norm > 0, norm, 1)
            for k in range(len(self.languages)):
                out[a:b, k] = np.bincount(text_of, x * self.weights[feature, k], b - a) * scale
            known[a:b] = letters
        return out, known


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def train_language_model(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, bits: int = 15, max_rows: int = 8_000, blocks: int = 8, rounds: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4) -> LanguageModel | None:
    """Fit on a bounded sample: about `max_rows` rows at most, chosen by the hash of `key` (by default of the text).

    Rows with a null text or language are left out.  None if there is no row at all.
    A fifth of the sample sets the temperature and is not trained on.
    """
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(key if key is not None else F.col(text_col)).alias("h"))
    tally = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    total, languages = sum(tally.values()), sorted(tally)
    if not total:
        return None
    share = min(1.0, max_rows / total)
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks + blocks // 4)))
    code, size = {k: i for i, k in enumerate(languages)}, 1 << bits

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts, langs, block = part["t"].tolist(), part["l"].tolist(), part["block"].tolist()
            for a, b, feature, counts, starts, _ in features(texts, bits):
                yield pd.DataFrame([(block[a + i], code[langs[a + i]], feature[starts[i] : starts[i + 1]].tobytes(), np.minimum(counts[starts[i] : starts[i + 1]], 65535).astype(np.uint16).tobytes()) for i in range(b - a)], columns=["block", "y", "feature", "count"])

    data = checkpointed(sample.mapInPandas(extract, "block long, y int, feature binary, count binary").repartition(blocks, "block").sortWithinPartitions("block", F.xxhash64("feature", "count")))

    def frequencies(part: pd.DataFrame) -> pd.DataFrame:
        df = np.bincount(np.frombuffer(b"".join(part["feature"]), np.int32), minlength=size)
        return pd.DataFrame({"n": [len(part)], "df": [df.astype(np.int64).tobytes()]})

    got = data.groupBy("block").applyInPandas(frequencies, "n long, df binary").collect()
    df, n_rows = sum(np.frombuffer(r["df"], np.int64) for r in got), sum(r["n"] for r in got)
    idf = np.log((1 + n_rows) / (1 + df)) + 1

    def vectors(part: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for y, f, c in zip(part["y"], part["feature"], part["count"], strict=True):
            f = np.frombuffer(f, np.int32)
            x = (1 + np.log(np.frombuffer(c, np.uint16))) * idf[f]
            yield y, f, x / max(1e-12, np.sqrt(x @ x))

    z, n = np.zeros((size, len(languages))), np.zeros((size, len(languages)))
    for _ in range(rounds):
        z0, n0 = z, n

        def leader(part: pd.DataFrame) -> pd.DataFrame:
            z, n = z0.copy(), n0.copy()
            for y, f, x in vectors(part):
                zf, nf = z[f], n[f]
                w = _weights(zf, nf, alpha, beta, l1, l2)
                p = _softmax(x @ w)
                p[y] -= 1
                g = x[:, None] * p
                more = nf + g * g
                z[f] = zf + g - (np.sqrt(more) - np.sqrt(nf)) / alpha * w
                n[f] = more
            return pd.DataFrame({"z": [z.tobytes()], "n": [n.tobytes()]})

        states = data.where(F.col("block") < blocks).groupBy("block").applyInPandas(leader, "z binary, n binary").collect()
        if states:
            z, n = (sum(np.frombuffer(s[k]) for s in states).reshape(z.shape) / len(states) for k in ("z", "n"))
    weights = _weights(z, n, alpha, beta, l1, l2)

    def losses(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(TEMPERATURES))
        for y, f, x in vectors(part):
            out -= np.log(np.maximum(_softmax((x @ weights[f])[None] / TEMPERATURES[:, None])[:, y], 1e-300))
        return pd.DataFrame({"loss": [out.tobytes()]})

    held = data.where(F.col("block") >= blocks).groupBy("block").applyInPandas(losses, "loss binary").collect()
    temperature = float(TEMPERATURES[np.argmin(sum(np.frombuffer(r["loss"]) for r in held))]) if held else 1.0
    return LanguageModel(languages, weights.astype(np.float32), idf, temperature, bits)


def predict_language(docs: DataFrame, model: LanguageModel | None, *, text_col: str = "text", out_cols: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the likeliest language and its calibrated probability, from the whole text alone.

    `und` with score 0 for null texts, texts without a letter, and without a model.
    Other columns pass; of those named like `out_cols`, the input's are replaced.
    """
    model_rows = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2**bits features

    @F.pandas_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model_rows.value
        for column in batches:
            if m is None:
                yield pd.DataFrame({"lang": ["und"] * len(column), "score": 0.0})
                continue
            logits, known = m.logits([t or "" for t in column])
            p = _softmax(logits / m.temperature)
            names = np.array(m.languages, object)
            yield pd.DataFrame({"lang": np.where(known, names[p.argmax(1)], "und"), "score": np.where(known, p.max(1), 0.0)})

    out = docs.withColumn("__lang", run(F.col(text_col)))
    return out.withColumn(out_cols[0], F.col("__lang.lang")).withColumn(out_cols[1], F.col("__lang.score")).drop("__lang")

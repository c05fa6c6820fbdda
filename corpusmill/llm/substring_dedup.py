"""Substring deduplication over fixed-length word windows.

Every window of `window` consecutive words gets two Rabin-Karp hashes.  Texts
are cut into chunks of consecutive ids.  A chunk sends each of its distinct
window hashes once, packed by hash bucket; a bucket counts them over all chunks
and answers with one bit for each hash it got: set if an earlier chunk has the
same window.  Each chunk then merges its repeated windows into maximal
intervals and drops their words.

A window that occurs in a third of all texts reaches its bucket once for each
chunk, never once for each text, so no task sees a hot passage whole.  What is
shuffled is the text once (both uses share the exchange) and 8 bytes for each
distinct window of a chunk.

Equality is that of a 64-bit hash and of the bucket number, which comes from a
second independent polynomial: with buckets of b hashes, a window is wrongly
taken for a copy with a chance of b / 2**64.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .wordhash import BASE_WORDS, hash_words, rolling, runs

#: Text bytes hashed at once in a task.
RUN_BYTES = 1 << 20


def chunk_column(df: DataFrame, id_col: str, text_col: str, chunk_bytes: int, at_least: int):
    """An expression that numbers chunks in the order of ids, and the number of text bytes.

    Bounds are id quantiles by rows (512 at most, one small aggregate); finer chunks divide
    the span between two bounds evenly, in decimals, as ids may use all 64 bits.  A repeated id that
    fills a span alone is divided by its rows' text hashes, in their order, as are null ids, which come last.
    """
    probs = [i / 512 for i in range(1, 512)]
    row = df.agg(F.sum(F.octet_length(text_col)), F.min(id_col), F.max(id_col), F.percentile_approx(id_col, probs, 20000)).first()
    size = row[0] or 0
    n = max(at_least, -(-size // chunk_bytes))
    by_hash = lambda parts: F.least(F.floor((F.xxhash64(text_col) / F.lit(2.0**64) + 0.5) * parts), parts - 1).cast("long")
    if row[1] is None:
        return by_hash(F.lit(n)).cast("int"), size
    ranges = min(n, 512)
    cuts = [row[1], *(row[3][min(510, max(0, round(i * 512 / ranges) - 1))] for i in range(1, ranges))]
    # An id at several cuts holds as many shares of the rows; its own span ends right after it.
    alone = {b for b, k in Counter(cuts).items() if k > 1}
    bounds = sorted({*cuts, *(b + 1 for b in alone if b < row[2])})
    finer = -(-n // ranges)
    shares = {b: finer * max(1, cuts.count(b)) for b in bounds}
    starts = np.concatenate(([0], np.cumsum([shares[b] for b in bounds])))
    ids, edges = F.col(id_col), F.array(*[F.lit(b).cast("long") for b in bounds])
    place = F.aggregate(edges, F.lit(0), lambda acc, b: acc + F.when(b <= ids, 1).otherwise(0))
    of = lambda values, kind: F.element_at(F.array(*[F.lit(str(v)).cast(kind) for v in values]), place)
    wide = "decimal(20,0)"
    low, span = of(bounds, wide), of([b - a for a, b in zip(bounds, [*bounds[1:], row[2] + 1], strict=True)], wide)
    parts = of([shares[b] for b in bounds], "long")
    inside = F.floor((ids.cast(wide) - low).cast("double") / span.cast("double") * parts).cast("long")
    inside = F.when(span == 1, by_hash(parts)).otherwise(F.least(F.greatest(inside, F.lit(0)), parts - 1))
    last = int(starts[-1])
    return F.when(ids.isNull(), last + by_hash(F.lit(n))).otherwise(of(starts[:-1], "long") + inside).cast("int"), size


class Windows:
    """Hashes of the windows of one chunk; `first` tells which are the first of their kind in it."""

    def __init__(self, texts: Sequence[bytes], window: int, buckets: int):
        starts, one, two, self.counts = [], [], [], np.zeros(len(texts), np.int64)
        base = 0
        for a, b in runs([len(t) for t in texts], RUN_BYTES):
            hashes, counts = hash_words(list(texts[a:b]))
            self.counts[a:b] = counts
            h, g = (rolling(hashes, window, k) for k in BASE_WORDS)
            text_of = np.repeat(np.arange(b - a), counts)
            inside = text_of[: len(h)] == text_of[window - 1 :][: len(h)] if len(h) else np.zeros(0, bool)
            starts.append(np.flatnonzero(inside) + base)
            one.append(h[inside])
            two.append(g[inside])
            base += len(hashes)
        self.words = base
        none = np.zeros(0, np.uint64)
        self.starts = np.concatenate([np.zeros(0, np.int64), *starts])
        self.hashes, other = np.concatenate([none, *one]), np.concatenate([none, *two])
        self.bucket = (other % np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(self.hashes, kind="stable")
        h, g = self.hashes[order], other[order]
        self.first = np.ones(len(order), bool)
        self.first[order[1:]] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        sent = np.flatnonzero(self.first)
        self.sent = sent[np.argsort(self.bucket[sent], kind="stable")]
        self.bounds = np.searchsorted(self.bucket[self.sent], np.arange(buckets + 1))

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        for k in np.flatnonzero(np.diff(self.bounds)):
            yield int(k), self.hashes[self.sent[self.bounds[k] : self.bounds[k + 1]]].tobytes()


def _repeated(blocks: pd.DataFrame) -> pd.DataFrame:
    """For each block of one bucket, a bit for each hash that an earlier chunk has too."""
    blocks = blocks.sort_values("chunk")
    sizes = np.array([len(b) // 8 for b in blocks["hashes"]])
    values = np.frombuffer(b"".join(blocks["hashes"]), np.uint64)
    order = np.argsort(values, kind="stable")
    again = np.zeros(len(values), bool)
    again[order[1:]] = values[order[1:]] == values[order[:-1]]
    ends = np.cumsum(sizes)
    rows = [(c, k, np.packbits(again[e - n : e]).tobytes()) for c, k, n, e in zip(blocks["chunk"], blocks["bucket"], sizes, ends, strict=True) if again[e - n : e].any()]
    return pd.DataFrame(rows, columns=["chunk", "bucket", "bits"])


def _intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), window: int = 20, chunk_bytes: int = 4 << 20, bucket_hashes: int = 2_000_000) -> DataFrame:
    """Remove every word inside a window of `window` words that also starts earlier (smaller id, or same text further left).

    Returns one row for each input row: `id_col`, the `keep` columns, `n_words`,
    `n_removed`, `spans` (removed word intervals [start, end), maximal) and
    `kept_text` (the other words joined by one space).

    Windows are judged on the input.  A null text counts as empty: no words and
    an empty `kept_text`.  Rows of the same id are ordered by text hash, then text; of fully
    equal rows the copies lose, whichever they are.  An empty table gives an empty one.  Null ids come after all
    others.  Other columns of `docs`, whatever their names, play no part.  A
    text of any length is handled whole, by one task.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.xxhash64(text_col).alias("tie"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    chunk, size = chunk_column(source, "id", "body", chunk_bytes, 2 * parts)
    buckets = max(2 * parts, -(-size // (6 * bucket_hashes)))
    chunks = source.withColumn("chunk", chunk).repartition(2 * parts, "chunk")

    def ordered(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes]]:
        rows = rows.assign(body=[(t or "").encode() for t in rows["body"]]).sort_values(["id", "tie", "body"], kind="stable", na_position="last")
        return rows, rows["body"].tolist()

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = int(rows["chunk"].iloc[0])
        _, texts = ordered(rows)
        return pd.DataFrame([(k, chunk, b) for k, b in Windows(texts, window, buckets).blocks()], columns=["bucket", "chunk", "hashes"])

    def remove(rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        rows, texts = ordered(rows)
        w = Windows(texts, window, buckets)
        again = ~w.first
        for k, packed in zip(bits["bucket"], bits["bits"], strict=True):
            mine = w.sent[w.bounds[k] : w.bounds[k + 1]]
            again[mine] = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(mine)).astype(bool)
        change = np.zeros(w.words + 1, np.int32)
        np.add.at(change, w.starts[again], 1)
        np.add.at(change, w.starts[again] + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        ends = np.cumsum(w.counts)
        removed, spans, kept = [], [], []
        for text, n, end in zip(texts, w.counts, ends, strict=True):
            mask, parts_ = gone[end - n : end], text.split()
            cut = _intervals(mask) if mask.any() else []
            left, at = [], 0
            for a, b in cut:
                left += parts_[at:a]
                at = b
            left += parts_[at:]
            removed.append(int(mask.sum()))
            spans.append([{"start": a, "end": b} for a, b in cut])
            kept.append(b" ".join(left).decode())
        return pd.DataFrame({"id": rows["id"], **{f"keep_{i}": rows[f"keep_{i}"] for i in range(len(keep))}, "n_words": w.counts, "n_removed": removed, "spans": spans, "kept_text": kept})

    answers = chunks.groupBy("chunk").applyInPandas(send, "bucket int, chunk int, hashes binary").groupBy("bucket").applyInPandas(_repeated, "chunk int, bucket int, bits binary")
    kinds = dict(source.dtypes)
    schema = ", ".join([f"id {kinds['id']}", *[f"keep_{i} {kinds[f'keep_{i}']}" for i in range(len(keep))], "n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"])
    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(remove, schema)
    return out.select(F.col("id").alias(id_col), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", "spans", "kept_text")

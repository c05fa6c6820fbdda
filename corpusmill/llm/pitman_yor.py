"""Hierarchical Pitman-Yor language model over words, and scores of texts by it.

Two levels: a restaurant for each context (the word before, hashed to `2**bits`
contexts, so that what all tasks share has a fixed size; the README has what this costs) whose parent is one
restaurant for all words, over a uniform base.  Each table of a context
restaurant is a customer of the parent, which all contexts share.

Texts become blocks of (word, context) occurrences dealt by word.  So a task has
all customers of its words: their seating in every context, and their tables in
the parent.  Words that would fill a good part of a task alone, and the end token,
are dealt by word and context instead; their counts are added up over the tasks and
seated in the parent on the driver, a few numbers for each of them.  What a task lacks
else are totals of a restaurant, which are summed over all tasks between sweeps and
handed out again (`2**bits` numbers).

A Gibbs sweep takes all customers of a (word, context) pair off their tables and seats
them again one after the other, given the totals and the parent of the sweep before,
all pairs in step.  After burn-in the predictive probabilities of several sweeps are
averaged; the score of a text is the sum of their logarithms.

Counting is exact and over all training texts.  Sums for each text come back in
packed rows; no count table is ever broadcast or collected.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions, text_bytes
from .wordhash import hash_words, mix, runs

#: Bytes and number of texts that a block holds at most (a longer text is alone); texts are numbered in 16 bits.
RUN_BYTES, RUN_TEXTS = 4 << 20, 60_000
#: Bytes hashed at once.
HASH_BYTES = 1 << 20
#: Customers of a dish that are seated singly.
ONE_BY_ONE = 12
#: Hashes of the end token and of the context before the first word.
END, START = 0x5DEECE66D1234567, 0x2545F4914F6CDD1D


def _blocks(buckets: int, bits: int, hot: np.ndarray):
    """Occurrences of a run of texts, packed by bucket of the word: distinct words, then (word, text, context) in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = None
        for rows in batches:
            if chunk is None and len(rows):
                chunk = int(rows["part"].iloc[0]) << 24
            texts = [(t or "").encode().lower() for t in rows["body"]]
            ids, train = rows["id"].to_numpy(object), rows["train"].to_numpy(bool)
            for a, b in runs([max(len(t), RUN_BYTES // RUN_TEXTS) for t in texts], RUN_BYTES):
                parts = [hash_words(texts[a + x : a + y]) for x, y in runs([len(t) for t in texts[a:b]], HASH_BYTES)]
                hashes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
                ends = np.cumsum(counts)
                tokens = np.insert(hashes, ends, np.uint64(END))
                owner = np.repeat(np.arange(b - a), counts + 1)
                before = np.roll(tokens, 1)
                before[np.append(0, np.cumsum(counts + 1)[:-1])] = START
                context = (mix(before, 9) >> np.uint64(64 - bits)).astype(np.uint32)
                spread = np.where(_among(tokens, hot) >= 0, mix(context.astype(np.uint64), 6), np.uint64(0))
                place = (mix(tokens ^ spread, 8) % np.uint64(buckets)).astype(np.int64)
                # Blocks are made twice, so each row tells of what rows its block was made.
                mark = zlib.crc32(repr((ids[a:b].tolist(), counts.tolist())).encode())
                order = np.lexsort((tokens, place))
                out = []
                for k, lo, hi in _segments(place[order]):
                    mine = order[lo:hi]
                    words, times = np.unique(tokens[mine], return_counts=True)
                    times = zlib.compress(times.astype(np.uint32).tobytes(), 1)
                    out.append((k, chunk, mark, b"".join((np.array([len(words), len(mine), b - a, len(times)], np.int64).tobytes(), words.tobytes(), times, np.packbits(train[a:b]).tobytes(), owner[mine].astype(np.uint16).tobytes(), _pack_contexts(context[mine], bits)))))
                out.append((-1 - chunk % buckets, chunk, mark, b"".join((np.array([-1 if i is None or i != i else int(i) for i in ids[a:b]], np.int64).tobytes(), (counts + 1).astype(np.int64).tobytes(), np.array([i is None or i != i for i in ids[a:b]], np.uint8).tobytes()))))
                yield pd.DataFrame(out, columns=["bucket", "chunk", "mark", "data"])
                chunk += 1

    return run


def _pack_contexts(context: np.ndarray, bits: int) -> bytes:
    """16 bits each, then the others (eight at most) side by side."""
    low = context.astype(np.uint16).tobytes()
    high = (context >> np.uint32(16)).astype(np.uint8)
    return low + (np.packbits(np.unpackbits(high[:, None], axis=1)[:, 24 - bits :]).tobytes() if bits > 16 else b"")


def _unpack_contexts(data: bytes, n: int, bits: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint16, n).astype(np.uint64)
    if bits > 16:
        high = np.unpackbits(np.frombuffer(data, np.uint8, -1, 2 * n), count=n * (bits - 16)).reshape(n, bits - 16)
        out |= (high @ (1 << np.arange(bits - 17, -1, -1))).astype(np.uint64) << np.uint64(16)
    return out


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _segments(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    starts = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else []
    for lo, hi in zip(starts, [*starts[1:], len(sorted_keys)], strict=True):
        yield int(sorted_keys[lo]), int(lo), int(hi)


class Bucket:
    """All occurrences of a bucket's words, and its (word, context) pairs with their training counts."""

    def __init__(self, rows: pd.DataFrame, bits: int):
        rows = rows.sort_values("chunk")
        words, word, text, context, train, self.chunks, self.marks = [], [], [], [], [], [], []
        base = 0
        for chunk, mark, data in zip(rows["chunk"], rows["mark"], rows["data"], strict=True):
            self.marks.append(int(mark))
            n_words, n, docs, packed = (int(x) for x in np.frombuffer(data, np.int64, 4))
            own = np.frombuffer(data, np.uint64, n_words, 32)
            at = 32 + 8 * n_words
            times = np.frombuffer(zlib.decompress(data[at : at + packed]), np.uint32)
            at += packed
            flags = np.unpackbits(np.frombuffer(data, np.uint8, (docs + 7) // 8, at), count=docs).astype(bool)
            at += (docs + 7) // 8
            owner = np.frombuffer(data[at : at + 2 * n], np.uint16)
            context.append(_unpack_contexts(data[at + 2 * n :], n, bits))
            words.append(own)
            word.append(times)
            text.append(owner.astype(np.int32) + base)
            train.append(flags[owner])
            self.chunks.append((int(chunk), docs))
            base += docs
        self.texts = base
        every, place = np.unique(np.concatenate(words), return_inverse=True)
        at, spread = 0, []
        for times in word:
            spread.append(np.repeat(place[at : at + len(times)], times))
            at += len(times)
        word, self.text, train = np.concatenate(spread), np.concatenate(text), np.concatenate(train)
        keys = word.astype(np.uint64) << np.uint64(bits) | np.concatenate(context)
        self.keys, self.pair = np.unique(keys, return_inverse=True)
        self.word, self.context = (self.keys >> np.uint64(bits)).astype(np.int64), (self.keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        self.count = np.bincount(self.pair[train], minlength=len(self.keys)).astype(np.int64)
        self.words, self.every = len(every), every
        self.word_count = np.bincount(self.word, self.count, self.words).astype(np.int64)
        #: Pairs whose seating is open; one customer is always one table.
        self.open = np.flatnonzero(self.count > 1)

    def sums(self, per_pair: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, per_pair[self.pair], self.texts)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, by their bytes, which compress well one after the other."""
    kind = np.uint32 if not len(values) or values.max() < 1 << 32 else np.uint64
    return kind().itemsize.to_bytes(1) + zlib.compress(values.astype(kind).view(np.uint8).reshape(len(values), kind().itemsize).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    size, flat = data[0], np.frombuffer(zlib.decompress(data[1:]), np.uint8)
    return np.frombuffer(flat.reshape(size, len(flat) // size).T.tobytes(), f"u{size}").astype(np.int64)


def seated(counts: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with `counts` customers, seated one after the other by the restaurant's rule, all dishes in step.

    With t tables for n customers the next opens one with chance fresh / (x + fresh), where x = n - discount * t.  The
    first `ONE_BY_ONE` customers are drawn so; then a dish goes from new table to new table at once.  The chance of
    none among m customers is G(x + m) G(x + fresh) / (G(x) G(x + m + fresh)) with the gamma function, and
    G(y) / G(y + fresh) is close to (y + (fresh - 1) / 2) ** -fresh for such y.
    """
    tables = (counts > 0).astype(np.int64)
    for n in range(1, ONE_BY_ONE):
        open_ = np.flatnonzero(counts > n)
        a = fresh[open_]
        tables[open_] += rng.random(len(open_)) * (n - discount * tables[open_] + a) < a
    open_ = np.flatnonzero(counts > ONE_BY_ONE)
    done = np.full(len(counts), ONE_BY_ONE, np.int64)
    while len(open_):
        n, t, total, a = done[open_], tables[open_], counts[open_], fresh[open_]
        x = np.maximum(n - discount * t + (a - 1) / 2, 0.25)
        wait = x * np.expm1(np.minimum(rng.exponential(size=len(open_)) / np.maximum(a, 1e-300), 60))
        at = n + np.maximum(np.ceil(np.minimum(wait, 4e18)), 1)
        new = at <= total
        done[open_] = np.where(new, at, total).astype(np.int64)
        tables[open_[new]] += 1
        open_ = open_[new & (done[open_] < total)]
    return tables


def _hot_words(source: DataFrame, buckets: int, sample_bytes: int = 8 << 20) -> np.ndarray:
    """Sorted hashes of words that make a quarter of a bucket or more (4 * buckets of them at most), and the end token.

    They are read off about `sample_bytes` of text, as this settles only where customers are dealt to; counts are not taken from it."""
    share = max(1, -(-text_bytes(source, "body") // sample_bytes))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [(t or "").encode().lower() for t in rows["body"]]
            for a, b in runs([len(t) for t in texts], HASH_BYTES):
                words, n = np.unique(hash_words(texts[a:b])[0], return_counts=True)
                yield pd.DataFrame({"word": words.astype(np.int64), "n": n})

    some = source.where(F.pmod(F.xxhash64("body"), F.lit(share)) == 0).select("body").mapInPandas(count, "word long, n long")
    seen = checkpointed(some.groupBy("word").agg(F.sum("n").alias("n")))
    least = (seen.agg(F.sum("n")).first()[0] or 0) / (4 * buckets)
    hot = [r["word"] for r in seen.where(F.col("n") > least).collect()]
    return np.unique(np.append(np.array(hot, np.int64).astype(np.uint64), np.uint64(END)))


def hpy_scores(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 18, sweeps: int = 3, burn_in: int = 1, concentration: float = 1.0, bucket_tokens: int = 1_500_000, seed: int = 11) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score), one row for each row of `docs`.

    Tokens are lower-cased words and one end.  `training` (null: true) marks the rows to
    learn from; it reads the columns of `docs`.  `base_score` sums log10((c + 1) / (N + V + 1)); `score` is the
    model's log10 probability.  Null texts are empty.  Discounts follow from the numbers of
    words seen once and twice.  With no training text both levels fall back to the uniform base.

    Ids are integers; rows with a null id, and rows that repeat one, come back once each, and learn and are scored like any
    other.  An empty table gives an empty one.  Texts of any length are read whole.  Other columns, whatever
    their names, play no part.  Blocks are made twice from `docs`: where a lost task would give its rows in
    another order (after an unsorted shuffle), hand in a checkpoint; else the job may stop with an error, never mix texts up.
    """
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), F.coalesce(training, F.lit(True)).alias("train"), F.spark_partition_id().alias("part"))
    buckets = max(-(-parts // 2), -(-text_bytes(source, "body") // (6 * bucket_tokens)))
    size = 1 << bits
    hot = _hot_words(source, buckets)
    # Made twice, for counting and for scoring, which costs less than keeping them.
    blocks = source.mapInPandas(_blocks(buckets, bits, hot), "bucket long, chunk long, mark long, data binary")
    mine = blocks.where("bucket >= 0").groupBy("bucket")

    def reduced(frame: DataFrame, width: int) -> np.ndarray:
        """Sum of packed rows of `width` numbers, in two steps."""

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [0], "sums": [_pack(sum(map(_unpack, rows["sums"])))]})

        two = frame.groupBy("part").applyInPandas(add, "part long, sums binary")
        return sum((_unpack(r["sums"]) for r in two.select("sums").collect()), np.zeros(width, np.int64))

    def tally(rows: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(rows, bits)
        one, shared = b.count == 1, _among(b.every, hot)
        own, mine = b.word_count[shared < 0], np.flatnonzero(shared >= 0)
        scalars = [b.word_count.sum(), (own > 0).sum(), one.sum(), (b.count == 2).sum(), (own == 1).sum(), (own == 2).sum()]
        sums = np.concatenate((np.bincount(b.context, b.count, size), np.bincount(b.context[one], minlength=size), scalars, np.bincount(shared[mine], b.word_count[mine], len(hot)))).astype(np.int64)
        pairs = [_pack(np.diff(b.word[b.open], prepend=0)), _pack(b.context[b.open]), _pack(b.count[b.open])]
        return pd.DataFrame([(int(rows["bucket"].iloc[0]), *pairs, _pack(np.bincount(b.word[one], minlength=b.words)), _pack(b.word_count), _pack(mine), _pack(shared[mine]), _pack(sums))], columns=["bucket", "word", "context", "count", "singles", "word_count", "hot_word", "hot", "sums"])

    counted = checkpointed(mine.applyInPandas(tally, "bucket long, word binary, context binary, count binary, singles binary, word_count binary, hot_word binary, hot binary, sums binary"))
    got = reduced(counted.select((F.col("bucket") % 16).alias("part"), "sums"), 2 * size + 6 + len(hot))
    customers, single, (n_train, n_words, pair1, pair2, word1, word2), hot_count = got[:size], got[size : 2 * size], got[2 * size : 2 * size + 6], got[2 * size + 6 :]
    customers, single = customers.astype(np.float32), single.astype(np.float32)
    n_words, word1, word2 = n_words + (hot_count > 0).sum(), word1 + (hot_count == 1).sum(), word2 + (hot_count == 2).sum()
    discount = [min(0.95, max(0.05, a / max(1.0, a + 2 * b))) for a, b in ((word1, word2), (pair1, pair2))]
    uniform = 1 / (n_words + 1)

    def parent(c: np.ndarray, t: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Probability of words with c customers at t tables of the parent, whose totals are given."""
        return (np.maximum(c - discount[0] * t, 0) + (concentration + discount[0] * totals[1]) * uniform) / (concentration + totals[0])

    # Between sweeps a bucket's state is the number of tables of its pairs (in their contexts) and words (in the parent).
    states: list[DataFrame] = []
    totals: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for sweep in range(sweeps):
        known = totals[-1] if totals else None

        def seat(own: pd.DataFrame, old: pd.DataFrame | None = None) -> pd.DataFrame:
            number = int(own["bucket"].iloc[0])
            word, context, count, singles, word_count, hot_word, hots = (_unpack(own[k].iloc[0]) for k in ("word", "context", "count", "singles", "word_count", "hot_word", "hot"))
            word = np.cumsum(word)
            rng = np.random.default_rng([seed, sweep, number])
            if old is None:
                word_count = word_count.astype(float)
                word_count[hot_word] = hot_count[hots]
                prob, tables_of = (word_count + uniform) / (n_train + 1), np.sqrt(customers)
            else:
                tables, top = (_unpack(old[k].iloc[0]) for k in ("tables", "top"))
                c = singles + np.bincount(word, tables, len(singles)).astype(np.int64)
                c[hot_word], top[hot_word] = known[2][hots], known[3][hots]
                prob, tables_of = parent(c, top, known[1]), known[0]
            tables = seated(count, (concentration + discount[1] * tables_of[context]) * prob[word], discount[1], rng)
            # The parent's customers are the tables just made.
            c = singles + np.bincount(word, tables, len(singles)).astype(np.int64)
            shared = np.bincount(hots, c[hot_word], len(hot))
            total = c.sum()
            c[hot_word] = 0
            top = seated(c, np.full(len(c), (concentration + discount[0] * n_words) * uniform), discount[0], rng)
            sums = np.concatenate((np.bincount(context, tables, size), [total, top.sum()], shared)).astype(np.int64)
            return pd.DataFrame([(number, sweep, _pack(tables), _pack(top), _pack(sums))], columns=["bucket", "sweep", "tables", "top", "sums"])

        schema = "bucket long, sweep int, tables binary, top binary, sums binary"
        if states:
            state = counted.groupBy("bucket").cogroup(states[-1].groupBy("bucket")).applyInPandas(lambda own, old: seat(own, old), schema)
        else:
            state = counted.groupBy("bucket").applyInPandas(lambda own: seat(own), schema)
        states.append(checkpointed(state))
        sums = reduced(states[-1].select((F.col("bucket") % 16).alias("part"), "sums"), size + 2 + len(hot))
        shared = sums[size + 2 :].astype(np.int64)
        top = seated(shared, np.full(len(hot), (concentration + discount[0] * n_words) * uniform), discount[0], np.random.default_rng([seed, sweep]))
        totals.append(((single + sums[:size]).astype(np.float32), sums[size : size + 2] + [0, top.sum()], shared, top))

    kept = states[burn_in].select("bucket", "sweep", "tables", "top")
    for state in states[burn_in + 1 :]:
        kept = kept.unionByName(state.select("bucket", "sweep", "tables", "top"))
    log_base = math.log10(n_train + n_words + 1)

    def score(rows: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(rows, bits)
        shared = _among(b.every, hot)
        mine = np.flatnonzero(shared >= 0)
        word_count = b.word_count.copy()
        word_count[mine] = hot_count[shared[mine]]
        mean = np.zeros(len(b.keys))
        for sweep, t, top in zip(old["sweep"], old["tables"], old["top"], strict=True):
            tables, top = (b.count > 0).astype(np.int64), _unpack(top)
            tables[b.open] = _unpack(t)
            context_tables, root, hot_c, hot_top = totals[sweep]
            c = np.bincount(b.word, tables, b.words)
            c[mine], top[mine] = hot_c[shared[mine]], hot_top[shared[mine]]
            p = parent(c, top, root)[b.word]
            mean += (np.maximum(b.count - discount[1] * tables, 0) + (concentration + discount[1] * context_tables[b.context]) * p) / (concentration + customers[b.context])
        sums = [b.sums(x) for x in ((word_count[b.word] > 0).astype(float), np.log10(word_count[b.word] + 1.0) - log_base, np.log10(mean / len(old)))]
        out, at = [], 0
        for (chunk, docs), mark in zip(b.chunks, b.marks, strict=True):
            known, base, own = (x[at : at + docs] for x in sums)
            some = np.flatnonzero(base)
            out.append((chunk, 1, mark, b"".join((np.array([len(some)], np.int64).tobytes(), base[some].tobytes(), own[some].tobytes(), known[some].astype(np.uint32).tobytes(), some.astype(np.uint16).tobytes()))))
            at += docs
        return pd.DataFrame(out, columns=["chunk", "kind", "mark", "data"])

    def collect(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["mark"].nunique() != 1 or (rows["kind"] == 0).sum() != 1:
            raise RuntimeError("the rows of docs came in another order the second time; hand in a checkpoint")
        head = rows.loc[rows["kind"] == 0, "data"].iloc[0]
        n = len(head) // 17
        ids, tokens, null = np.frombuffer(head, np.int64, n), np.frombuffer(head, np.int64, n, 8 * n), np.frombuffer(head, np.uint8, n, 16 * n)
        known, base, own = np.zeros(n), np.zeros(n), np.zeros(n)
        for data in rows.loc[rows["kind"] == 1].sort_values("data")["data"]:
            k = int(np.frombuffer(data, np.int64, 1)[0])
            at = np.frombuffer(data[8 + 20 * k :], np.uint16)
            base[at] += np.frombuffer(data, np.float64, k, 8)
            own[at] += np.frombuffer(data, np.float64, k, 8 + 8 * k)
            known[at] += np.frombuffer(data, np.uint32, k, 8 + 16 * k)
        return pd.DataFrame({"id": pd.Series(ids).astype("Int64").mask(null.astype(bool)), "n_tokens": tokens, "n_known": known.astype(np.int64), "base_score": base, "score": own})

    parts_ = blocks.where("bucket >= 0").groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInPandas(score, "chunk long, kind int, mark long, data binary")
    heads = blocks.where("bucket < 0").select("chunk", F.lit(0).alias("kind"), "mark", "data")
    out = parts_.unionByName(heads).groupBy("chunk").applyInPandas(collect, "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")

"""Token ids in binary shard files, each one wavelet matrix with a table of its documents.

Rows are ordered by id over range partitions; every task encodes its range in
order and closes a shard once it has `shard_ids` ids, so that a shard is bounded
by that and one document, and no shuffle moves ids.  A shard is one file of its
own, written and read by Spark's file sources: any store and a lost executor are
theirs to handle.  A file is

    magic, range, number in the range, documents    4 + 3 * 8 bytes
    ids of documents, which are null, their sizes    8 + 1 + 4 bytes each
    the wavelet matrix of all ids, one newline

and is read alone: `ShardFile` gives ids at positions, counts and places of a token.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import spread
from .common import checkpointed, shuffle_partitions
from .wavelet import WaveletMatrix, pack
from .wordhash import runs

MAGIC = b"TWM1"
HEAD = struct.Struct("<4sqqq")
#: Words that a task remembers, words that the library gets at once, and bytes of texts handled together.
MEMO_WORDS, CALL_WORDS, RUN_BYTES = 3 << 19, 128, 1 << 22


class WordEncoder:
    """Ids as the tokenizers library gives them for whole texts, each distinct word encoded once.

    For vocabularies that drop white space before they split, so that no id depends on what stands beyond it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tool, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tool in (self.tool, self.plain):
            tool.no_padding()
            tool.no_truncation()
        # Small ASCII letters are not changed or cut by the vocabulary's rules, so its model alone is asked for them.
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.plain.model._resize_cache(0)
        self.closes = np.zeros(max(self.tool.get_vocab().values()) + 1, bool)
        for token, i in self.tool.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        probe = ["abcdefghijklm nopqrstuvwxyz the unlikeliest of words"]
        if self.encoded(self.plain, probe) != self.encoded(self.tool, probe):
            raise ValueError("this vocabulary changes or cuts plain words")
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])

    def encoded(self, tool, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tool.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: Iterable[bytes]) -> None:
        """Add words that are not known yet.

        Letters are one piece; many words go in one call, each ending at the id that closes a word.  ASCII letters
        are the same in both cases, and the model alone is asked for them.  A stop or comma behind letters is a piece of
        its own.  All other words go one by one.
        """
        number, flat, starts = self.number, self.flat, self.starts
        new = [(w, _letters(w)) for w in words]
        cores = [c for c in {c for _, c in new if c} if c not in number]
        odd: list[bytes] = []
        for tool, some in ((self.plain, [c for c in cores if c.isascii()]), (self.tool, [c for c in cores if not c.isascii()])):
            calls = [some[a : a + CALL_WORDS] for a in range(0, len(some), CALL_WORDS)]
            for call, ids in zip(calls, self.encoded(tool, [b" ".join(c).decode() for c in calls]), strict=True):
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) != len(call):  # small letters that are more than one letter
                    odd += call
                    continue
                number.update(zip(call, range(len(starts) - 1, len(starts) - 1 + len(call)), strict=True))
                starts.extend((ends + len(flat)).tolist())
                flat.extend(ids)
        for word, ids in zip(odd, self.encoded(self.tool, [w.decode() for w in odd]), strict=True):
            number[word] = len(starts) - 1
            flat.extend(ids)
            starts.append(len(flat))
        tails = {t: array("I", self.encoded(self.tool, [t.decode()])[0]) for t in (b".", b",")}
        for word, core in new:
            if core and word not in number:
                i = number[core]
                number[word] = len(starts) - 1
                flat.extend(flat[starts[i] : starts[i + 1]])
                if word[-1:] in tails:
                    flat.extend(tails[word[-1:]])
                starts.append(len(flat))
        other = [w for w, core in new if not core]
        for word, ids in zip(other, self.encoded(self.tool, [w.decode() for w in other]), strict=True):
            number[word] = len(starts) - 1
            flat.extend(ids)
            starts.append(len(flat))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by `end`, end to end, and the size of each."""
        words = [t.split() for t in texts]
        every = [w for own in words for w in own]
        if len(self.number) > MEMO_WORDS:
            self.clear()
        kinds = np.fromiter(map(self.number.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(kinds < 0).tolist()
        self.learn({every[i] for i in missing})
        kinds[missing] = [self.number[every[i]] for i in missing]
        ids, starts = np.append(np.frombuffer(self.flat, np.uint32), np.uint32(end)), np.frombuffer(self.starts, np.int64)
        stops = np.cumsum([len(own) for own in words])
        out, at = spread(ids, starts, np.append(np.diff(starts), 1), np.insert(kinds, stops, len(starts) - 1))
        return out, np.diff(at[stops + np.arange(1, len(texts) + 1)], prepend=0)


def _letters(word: bytes) -> bytes | None:
    """The word if it is letters, with one stop or comma at most behind them, which goes; ASCII letters become small ones."""
    core = word[:-1] if word[-1:] in (b".", b",") else word
    if core.isalpha():
        return core.lower()
    return core if not core.isascii() and core.decode().isalpha() else None


@lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def shard_bytes(place: tuple[int, int], docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    own = np.array([d or 0 for d in docs], "<i8")
    null = np.array([d is None for d in docs], np.uint8)
    return b"".join([HEAD.pack(MAGIC, *place, len(docs)), own.tobytes(), null.tobytes(), sizes.astype("<u4").tobytes(), pack(ids)])


class ShardFile:
    """One shard: its place, its documents and the matrix of their ids."""

    def __init__(self, data: bytes):
        magic, *self.place, n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEAD.size
        null = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.docs = [None if gone else d for d, gone in zip(np.frombuffer(data, "<i8", n, at).tolist(), null.tolist(), strict=True)]
        self.sizes = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = WaveletMatrix(memoryview(data)[at + 13 * n :])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 2, shard_ids: int = 1 << 19, partitions: int | None = None) -> None:
    """Write the ids of all texts in ascending order of ids (null first, equal ids by a hash of the text), each text closed by `end`.

    `tokenizer` is a file of the tokenizers library whose vocabulary drops white space.  A null text is an empty
    one.  Repeated rows are all written.  A very long text makes a longer shard.  An empty table makes no shards.
    Other columns play no part.  The folder must be new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, number = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        owners: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            file = shard_bytes((part, number), owners, np.concatenate(sizes), np.concatenate(ids))
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.binary())})

        for batch in batches:
            texts, mine = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(0).to_pylist()
            for a, b in runs([len(t) for t in texts], RUN_BYTES):
                more, counts = tool.encode(texts[a:b], end)
                for c, d in runs(counts.tolist(), shard_ids):
                    before, after = counts[:c].sum(), counts[:d].sum()
                    owners += mine[a + c : a + d]
                    sizes.append(counts[c:d])
                    ids.append(more[before:after])
                    if sum(map(len, ids)) >= shard_ids:
                        yield close()
                        owners, sizes, ids, number = [], [], [], number + 1
        if owners:
            yield close()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # The order is sampled on the driver, so it holds a hash and not the text.
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = source.repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), *order)
    files = dealt.sortWithinPartitions(*order).mapInArrow(run, "file binary")
    # The text sink writes a string's bytes as they are; one record for each file.
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """(content): the bytes of each shard file."""
    return spark.read.format("binaryFile").load(folder).where("length > 0").select("content")


def _each(rows, names: list[str], kinds: list[pa.DataType]):
    """An Arrow map that gives rows(shard) for each shard file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                columns = rows(ShardFile(data.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _document_rows(shard: ShardFile) -> list:
    ids, n = shard.ids.all().astype("<u4"), len(shard.docs)
    crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(shard.starts.tolist(), shard.sizes.tolist(), strict=True)]
    return [shard.docs, [shard.place[0]] * n, [shard.place[1]] * n, shard.starts, shard.sizes, crc]


def file_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; start counts the ids of all documents before.

    Ids of a shard are decoded at once; starts come from the sizes of the shards before, summed within ranges and over them.
    """
    kinds = [pa.int64()] * 6
    names = ["doc_id", "part", "number", "at", "n_tokens", "ids_crc32"]
    rows = checkpointed(shards(spark, folder).mapInArrow(_each(_document_rows, names, kinds), ", ".join(f"{c} long" for c in names)))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    inside = sizes.select("part", "number", F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("number")), F.lit(0)).alias("inside"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each range partition
    across = parts.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("across"))
    placed = rows.join(inside.join(across, "part"), ["part", "number"])
    return placed.select("doc_id", (F.col("across") + F.col("inside") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_places(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, doc_id, place): each occurrence of the tokens, by its document and place there, found without decoding the shards."""

    def rows(shard: ShardFile) -> list:
        found = [(t, shard.ids.occurrences(t)) for t in dict.fromkeys(tokens)]
        at = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int64)
        doc = np.searchsorted(shard.starts, at, "right") - 1
        return [np.repeat([t for t, _ in found], [len(p) for _, p in found]), [shard.docs[d] for d in doc], at - shard.starts[doc]]

    names = ["token", "doc_id", "place"]
    return shards(spark, folder).mapInArrow(_each(rows, names, [pa.int64()] * 3), ", ".join(f"{c} long" for c in names))


def token_counts_in(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, occurrences) over all shards, by rank queries alone."""
    wanted = list(dict.fromkeys(tokens))
    counted = shards(spark, folder).mapInArrow(_each(lambda s: [wanted, [s.ids.count(t) for t in wanted]], ["token", "n"], [pa.int64()] * 2), "token long, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("occurrences"))

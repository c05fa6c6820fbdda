"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

The bytes of a piece are read as Latin-1 for an Aho-Corasick automaton that
holds all tokens.  From each position the longest token is tried first; a token
is taken if it may follow its predecessor (memoised), else its next shorter
prefix token is tried, and a position from which nothing works is left for good.
Each position is given up at most once, so the time is linear in the length of a
piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .bpe import Ranks
from .wordhash import runs

#: Pieces of at most this many characters are remembered, so many of them.
MEMO_CHARS, MEMO_PIECES = 48, 300_000
RUN_CHARS = 1 << 20


class Encoder:
    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.ranks = Ranks.from_tiktoken(path)
        self.find = regex.compile(pattern).findall
        self.usual = pattern == pieces.PATTERN  # for which there is a vectorised cutter
        self.bytes: tuple | None = None
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.ranks.tokens):
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in self.ranks.tokens]
        self.shorter: dict[int, int] = {}
        self.memo: dict[str, tuple[int, ...]] = {}  # tuples of integers, which the collector need not visit

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of `token`, or -1."""
        if (have := self.shorter.get(token)) is None:
            text = self.ranks.tokens[token]
            have = next((r for n in range(len(text) - 1, 0, -1) if (r := self.ranks.rank.get(text[:n])) is not None), -1)
            self.shorter[token] = have
        return have

    def piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.rank.get(data)) is not None:
            return [whole]
        n, lengths, known, fits = len(data), self.lengths, self.ranks.known.get, self.ranks.fits
        longest = [-1] * n
        size = [0] * n
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            if length > size[at := end - length + 1]:
                size[at], longest[at] = length, token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            end = at + lengths[token]
            if open_[end] and (last < 0 or (fits(last, token) if (ok := known(last << 32 | token)) is None else ok)):
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            elif (token := self.prefix(token)) < 0:
                open_[at] = 0
                token = out.pop()
                last = out[-1] if out else -1
                at -= lengths[token]
        return out

    def encode(self, text: str) -> list[int]:
        memo, ids = self.memo, []
        get = memo.get
        for piece in self.find(text):
            if (have := get(piece)) is None:
                have = tuple(self.piece(piece.encode()))
                if len(piece) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = have
            ids += have
        return ids

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start (one more at the end).

        Each distinct piece of the batch is looked up once; its ids are then spread
        over all its places with array operations.
        """
        if not self.usual:
            each = [self.encode(t) for t in texts]
            return np.fromiter((i for ids in each for i in ids), np.int32), np.cumsum([0, *map(len, each)])
        whole = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = pieces.cut(points, (ends - sizes)[sizes > 0])
        where, kind = pieces.distinct(points, starts)
        stops = np.append(starts[1:], len(points))
        memo, found = self.memo, []
        for a, b in zip(starts[where].tolist(), stops[where].tolist(), strict=True):
            piece = whole[a:b]
            if (have := memo.get(piece)) is None:
                have = tuple(self.piece(piece.encode()))
                if b - a <= MEMO_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = have
            found.append(have)
        counts = np.array([len(f) for f in found])
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        ids, before = spread(flat, np.cumsum(counts) - counts, counts, kind)
        return ids, before[np.searchsorted(starts, np.append(0, ends))]

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and where each text's bytes start."""
        if self.bytes is None:
            sizes = np.array(self.lengths)
            self.bytes = np.frombuffer(b"".join(self.ranks.tokens), np.uint8), np.cumsum(sizes) - sizes, sizes
        data, before = spread(*self.bytes, ids)
        return data, before[bounds]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))


def spread(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of `flat` named by `kind`, end to end, and where each begins (one more at the end)."""
    size = counts[kind]
    before = np.append(0, np.cumsum(size))
    return flat[np.arange(before[-1]) + np.repeat(starts[kind] - before[:-1], size)], before


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def bpe_encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Add the token ids of each text, and with `decoded_col` the bytes they decode to.

    Every match of `pattern` is encoded by itself, without special tokens.  A null
    or empty text has no ids and decodes to no bytes.  A column of the added
    name is replaced; all others pass.  Long texts are encoded whole; no rows move between tasks.
    """
    import pyarrow as pa

    own = "__bpe_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(own).to_pylist()
            rest = batch.drop_columns([own])
            for a, b in runs([len(t or "") for t in texts], RUN_CHARS):
                ids, bounds = tool.encode_many([t or "" for t in texts[a:b]])
                part = rest.slice(a, b - a)
                columns = {**dict(zip(part.schema.names, part.columns, strict=True)), "__ids": pa.ListArray.from_arrays(bounds.astype(np.int32), ids)}
                if decoded_col:
                    data, at = tool.decode_many(ids, bounds)
                    columns["__decoded"] = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_pydict(columns)

    drop = [c for c in (ids_col, decoded_col) if c in docs.columns]
    keep = docs.drop(*drop).columns
    source = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col(text_col).alias(own))
    kinds = dict(source.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in source.columns if c != own] + ["`__ids` array<int>"] + ["`__decoded` binary"] * bool(decoded_col))
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], F.col("__ids").alias(ids_col), *([F.col("__decoded").alias(decoded_col)] if decoded_col else []))


def bpe_decode(rows: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that an id column decodes to; null ids give null."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        tool = encoder(path, pattern)
        return column.map(lambda ids: None if ids is None else tool.decode(list(ids)))

    return rows.withColumn(out_col, run(ids_col))

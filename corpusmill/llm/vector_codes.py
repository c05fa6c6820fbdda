"""Product codes of vectors: Lloyd rounds whose assignments are exact Exponion searches in integers.

A vector's components become integers and are cut into parts; each part position
has a codebook.  A search starts at the part's entry of the round before, at
squared distance u.  An entry that is no farther is within twice that distance of the
first entry, so only the first entry's neighbours with a squared distance of 4u at
most are compared, from its list of neighbours sorted by distance.  Distances are
exact, and ties go to the lower index.

Codebooks have a fixed size and go to every task; rows stay in their partitions
from round to round, and a round shuffles a row of sums for each entry and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Neighbours compared at once.
STEP = 16


def exact(size: int, most: int) -> type:
    """A number type in which four squared distances of parts of `size` components up to `most` are exact."""
    bound = 16 * size * int(most) ** 2
    if bound >= 1 << 63:
        raise ValueError(f"components of {most} have no exact 64-bit distances")
    return np.float64 if bound < 1 << 53 else np.int64


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by squared distance (ties by index), and these distances."""
    gaps = ((book[:, None] - book[None]) ** 2).sum(-1)
    order = np.argsort(gaps, 1, kind="stable")
    return order, np.take_along_axis(gaps, order, 1)


def nearest(x: np.ndarray, book: np.ndarray, start: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry and its squared distance, from the entries in `start` on."""
    order, gaps = near
    kind = exact(x.shape[1], max(abs(x).max(initial=0), abs(book).max(initial=0)))
    x, entries = x.astype(kind), book.astype(kind)
    norms, own = (entries**2).sum(1), (x**2).sum(1)
    best = own - 2 * (x * entries[start]).sum(1) + norms[start]
    found = start.astype(np.int64)
    by_start = np.argsort(start, kind="stable")
    for rows in np.split(by_start, np.flatnonzero(np.diff(start[by_start])) + 1):
        if not len(rows):
            continue
        first = start[rows[0]]
        reach = np.searchsorted(gaps[first], 4 * best[rows], "right")
        rows = rows[np.argsort(-reach, kind="stable")]
        reach = -np.sort(-reach)
        low, at = best[rows], found[rows]
        for a in range(0, reach[0], STEP):
            n = np.searchsorted(-reach, -a)  # rows that reach beyond a
            some = np.sort(order[first, a : a + STEP])
            gap = own[rows[:n], None] - 2 * (x[rows[:n]] @ entries[some].T) + norms[some]
            k = gap.argmin(1)
            gap, k = gap[np.arange(n), k], some[k]
            closer = (gap < low[:n]) | (gap == low[:n]) & (k < at[:n])
            low[:n], at[:n] = np.where(closer, gap, low[:n]), np.where(closer, k, at[:n])
        best[rows], found[rows] = low, at
    return found, best.astype(np.int64)


def _vectors(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    column = batch.column(name)
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1)


def _assign(books: np.ndarray):
    near = [neighbours(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _vectors(batch, "x", np.int64), _vectors(batch, "codes", np.uint8)
            found = [nearest(p, b, codes[:, i], n) for i, (p, b, n) in enumerate(zip(np.split(x, len(books), 1), books, near, strict=True))]
            out = np.stack([f for f, _ in found], 1).astype(np.uint8)
            error = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("x"), pa.array([c.tobytes() for c in out], pa.binary()), pa.array(error)], ["id", "label", "x", "codes", "error"])

    return run


def _sums(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _vectors(batch, "x", np.int64), _vectors(batch, "codes", np.uint8)
            if total is None:
                total, count = np.zeros((parts, 256, x.shape[1] // parts), np.int64), np.zeros((parts, 256), np.int64)
            for i, part in enumerate(np.split(x, parts, 1)):
                order = np.argsort(codes[:, i], kind="stable")
                entry, first, n = np.unique(codes[order, i], return_index=True, return_counts=True)
                total[i, entry] += np.add.reduceat(part[order], first)
                count[i, entry] += n
        if total is not None:
            i, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(entry), pa.array(count[i, entry]), pa.array(total[i, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def vector_codes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> tuple[DataFrame, np.ndarray]:
    """((id_col, label_col, codes, error, label_error) for each kept row, the codebooks as an array of parts, entries and components).

    Kept are rows whose vector has no null or non-finite component; of these, rows whose vector is empty, or has
    another length than that of the smallest id, are left out too.  A component becomes floor(scale * x); one too
    large for exact 64-bit distances is an error.  Codebooks start from the smallest ids (null last, equal ids by vector), all rows if there are
    fewer; repeated rows count as often as they occur.  An entry that no part has stays as it is.  `codes` has a
    byte for each part.  `label_error` sums `error` over equal labels, nulls together.  An empty table gives no rows
    and no codebook.  Very long vectors and clashing names of other columns need no care: only these three columns are read.
    """
    fine = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(fine)
    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vector_col, lambda v: F.floor(v.cast("double") * scale)).alias("v"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    label_type = dict(rows.dtypes)["label"]
    if not first:
        empty = rows.select("id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).limit(0)
        return empty.toDF(id_col, label_col, "codes", "error", "label_error"), np.zeros((parts, 0, 0), np.int64)
    size = len(first[0].v)
    if size % parts:
        raise ValueError(f"{size} components cannot be cut into {parts} equal parts")
    start = np.array([r.v for r in first if len(r.v) == size], np.int64)
    if len(start) < len(first):
        more = rows.where(F.size("v") == size).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        start = np.array([r.v for r in more], np.int64)
    books = np.stack(np.split(start, parts, 1))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, size)
            exact(size // parts, abs(x).max(initial=0))
            zeros = pa.array([bytes(parts)] * len(x), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), zeros, pa.array(np.zeros(len(x), np.int64))], ["id", "label", "x", "codes", "error"])

    schema = f"id {dict(rows.dtypes)['id']}, label {label_type}, x binary, codes binary, error long"
    state = rows.where(F.size("v") == size).mapInArrow(integers, schema)
    for _ in range(rounds):
        state = checkpointed(state.mapInArrow(_assign(books), schema))
        sums = state.select("x", "codes").mapInArrow(_sums(parts), "part long, entry long, n long, sums array<long>")
        total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size // parts)]
        books = books.copy()
        for r in sums.groupBy("part", "entry").agg(F.sum("n"), *total).collect():  # parts * entries rows at most
            books[r[0], r[1]] = np.array(r[3:], np.int64) // r[2]
    done = checkpointed(state.mapInArrow(_assign(books), schema).select("id", "label", "codes", "error"))
    errors = done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = done.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error", "label_error"), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(codebooks_text(books).encode()).hexdigest()

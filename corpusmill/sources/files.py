"""Files that are neither tables nor lines: token caches of NumPy, metric reports, and archives of LaTeX sources."""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def token_caches(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """(path, part, ids): the integers of each .npy file under `path` in parts of `chunk`, in order; an empty file gives no part.

    A file that is not a flat array of integers is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.load(io.BytesIO(data.as_buffer()), allow_pickle=False)
                if ids.ndim != 1 or ids.dtype.kind not in "iu":
                    raise ValueError(f"{name} is no flat array of integers")
                for i in range(0, len(ids), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // chunk]), pa.array([ids[i : i + chunk].astype(np.int64)], pa.list_(pa.int64()))], ["path", "part", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, part long, ids array<long>")


def metric_reports(spark: SparkSession, path: str, schema: str, name_pattern: str, names: Sequence[str]) -> DataFrame:
    """One row for each well-formed JSON file that the glob `path` finds: what the groups of `name_pattern` find in its path, and its fields.

    Files whose path does not fit the pattern are left out, and so are malformed ones.
    """
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).json(path).withColumn("__path", F.input_file_name())
    good = rows.where(F.col("_corrupt_record").isNull() & F.col("__path").rlike(name_pattern)).drop("_corrupt_record")
    return good.select(*[F.regexp_extract("__path", name_pattern, i).alias(n) for i, n in enumerate(names, 1)], *[c for c in good.columns if c != "__path"])


def latex_sources(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, text): the longest .tex or .txt member of each archive (tar, gzipped or not), or the text of a plain gzip or text file.

    Bytes that are not UTF-8 are replaced.  An archive without such a member, or a broken one, has a null text.
    """

    def unpack(data: bytes) -> tuple[str | None, str | None]:
        try:
            plain = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
            with tarfile.open(fileobj=io.BytesIO(plain)) as archive:
                members = [m for m in archive.getmembers() if m.isfile() and m.name.endswith((".tex", ".txt"))]
                best = max(members, key=lambda m: m.size, default=None)
                return (best.name, archive.extractfile(best).read().decode("utf-8", "replace")) if best else (None, None)
        except tarfile.ReadError:
            return None, plain.decode("utf-8", "replace")
        except (zlib.error, EOFError):
            return None, None

    @F.pandas_udf("struct<member:string,text:string>")
    def run(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unpack(bytes(f)) for f in files], columns=["member", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", run("content").alias("f")).select("path", "f.*")

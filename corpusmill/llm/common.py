"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Word separators of every operator here, as a Java and RE2 class.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of `sf_dir` with Spark's reader; Python workers learn where this library is."""
    have = spark.sparkContext.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{have}"
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir (a temporary one only where none is set)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="corpusmill-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that Spark writes, beside the checkpoints."""
    return f"{_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def compact(df: DataFrame, rows_each: int = 1 << 14) -> DataFrame:
    """`df` checkpointed and read in tasks of about `rows_each` short rows, so that small tables do not shuffle through thousands of tiny files."""
    out = checkpointed(df)
    return out.coalesce(ceil_div(out.count(), rows_each) or 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)

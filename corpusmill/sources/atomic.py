"""Tables that are rewritten at once: each version in a folder of its own, and one small file that names the current one.

A version is written whole before the name file is replaced, by a rename that
file systems make atomic; a writer that fails, is repeated or is killed leaves
readers the version they had.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

NAME, VERSIONS = "_CURRENT", "versions"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    return fs, fs.FileContext.getFileContext(fs.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that readers get, or None where nothing was published."""
    fs, files = _files(spark, path)
    name = fs.Path(path, NAME)
    if not files.util().exists(name):
        return None
    stream = files.open(name)
    try:
        return "".join(iter(lambda: chr(b) if (b := stream.read()) >= 0 else "", "")).strip()
    finally:
        stream.close()


def rewrite(df: DataFrame, path: str, format: str = "parquet") -> str:
    """Write `df` as the new version of the table at `path`, which `df` may read itself; returns the version."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.format(format).save(f"{path}/{VERSIONS}/{version}")
    fs, files = _files(spark, path)
    option = spark.sparkContext._jvm.org.apache.hadoop.fs
    draft = fs.Path(path, f"_draft-{version}")
    flags = spark.sparkContext._jvm.java.util.EnumSet.of(option.CreateFlag.CREATE)
    stream = files.create(draft, flags, spark.sparkContext._gateway.new_array(getattr(option, "Options$CreateOpts"), 0))
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    renames = spark.sparkContext._gateway.new_array(getattr(option, "Options$Rename"), 1)
    renames[0] = getattr(option, "Options$Rename").OVERWRITE
    files.rename(draft, fs.Path(path, NAME), renames)
    return version


def read(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """The current version of the table at `path`."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no published version")
    return spark.read.format(format).load(f"{path}/{VERSIONS}/{version}")


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete all versions but the current one, for when no reader uses them any more; returns how many went."""
    fs, files = _files(spark, path)
    keep, gone = current_version(spark, path), 0
    for status in files.util().listStatus(fs.Path(path, VERSIONS)):
        if status.getPath().getName() != keep:
            files.delete(status.getPath(), True)
            gone += 1
    return gone

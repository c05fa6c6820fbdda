"""Sources and sinks: Parquet, JSON lines, CSV, TSV, whole files; partitioned, sharded and resumable output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hive_parquet(spark: SparkSession, base: str) -> DataFrame:
    """A partitioned table; partition columns come from the directories."""
    return spark.read.option("basePath", base).parquet(base)


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: str, source: str | None = None) -> DataFrame:
    """JSON lines with malformed ones kept in a column, for counting; null lines go."""
    df = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return df.withColumn("source", F.lit(source)) if source else df


def valid_lines(df: DataFrame, key: str, text: str, least: int = 1) -> DataFrame:
    """Well-formed lines that have a key and `least` characters of text."""
    return df.where(F.col(CORRUPT).isNull() & F.col(key).isNotNull() & (F.length(F.trim(text)) >= least)).drop(CORRUPT)


def line_counts(df: DataFrame, text: str) -> DataFrame:
    """One row: lines, malformed, without text."""
    bad = F.col(CORRUPT).isNotNull()
    return df.agg(F.count("*").alias("lines"), F.sum(bad.cast("long")).alias("malformed"), F.sum((~bad & (F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0)).cast("long")).alias("empty"))


def csv_strings(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """All columns as strings; empty fields stay empty strings.  Gzip files are read as such."""
    return spark.read.option("header", header).option("sep", sep).option("nullValue", "\u0000").option("emptyValue", "").csv(path)


def first_per_id(crosswalk: DataFrame, key: str, value: str) -> DataFrame:
    """One value for each non-empty key: the smallest, as files have no order in a cluster."""
    return crosswalk.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(value).alias(value))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; comments (#) and blanks go."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> '' and not startswith(id, '#')")


def whole_files(spark: SparkSession, path: str, name_pattern: str) -> DataFrame:
    """(name, text) of each file; the name is group 1 of the pattern over the path."""
    df = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return df.select(F.regexp_extract("path", name_pattern, 1).alias("name"), "text")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, lines) of the files under a path; contents are not moved."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.regexp_count(F.decode("content", F.lit("UTF-8")), F.lit("\n")).alias("lines"))


def inventory_ids(keys: DataFrame, pattern: str, low: int, high: int) -> DataFrame:
    """Distinct numbers that the pattern finds in object keys, within bounds."""
    return keys.select(F.regexp_extract("key", pattern, 1).try_cast("long").alias("id")).where(F.col("id").between(low, high)).distinct()


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], rows_per_file: int = 0) -> None:
    """Partitioned Parquet with ZSTD; rows of a partition value meet before writing, in files of bounded size."""
    out = df.repartition(*by).write.mode("overwrite").partitionBy(*by).option("compression", "zstd")
    (out.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the output does not have yet; returns how many.  A second call with the same rows adds none."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    out = jvm.org.apache.hadoop.fs.Path(path)
    there = out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(out)
    fresh = df.dropDuplicates([key])
    if there:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    return n


def shard_of(rank: Column, total: int | Column, shards: int) -> Column:
    """Shard of a zero-based rank with bounds total * i // shards."""
    return F.floor(((rank + 1) * shards - 1) / total)


def build_report(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(report) one JSON row: rows, and counts by each dimension."""
    parts = [df.groupBy(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n")) for d in dims]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    groups = every.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("counts"))
    return groups.agg(F.to_json(F.sort_array(F.collect_list(F.struct("dim", "counts")))).alias("report"))

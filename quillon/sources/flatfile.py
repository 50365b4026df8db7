"""One contiguous content per file with an offset table, and reading pieces back by offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def offset_table(pieces: DataFrame, file: str, ordinal: str, content: str) -> DataFrame:
    """file, ordinal, offset, length."""
    n = F.length(content)
    w = Window.partitionBy(file).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(file, ordinal, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("offset"), n.alias("length"))


def concatenate(pieces: DataFrame, file: str, ordinal: str, content: str) -> DataFrame:
    """file, content: the pieces one after another (a file is one value, so at most 2 GB)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(ordinal), F.hex(content).alias("hex"))))
    return pieces.groupBy(file).agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["hex"]), "")).alias("content"))


def read_pieces(files: DataFrame, offsets: DataFrame, file: str) -> DataFrame:
    """offsets with the bytes found there; short_read where the file ends too early."""
    got = F.expr("substring(content, CAST(offset AS INT) + 1, CAST(length AS INT))")
    return offsets.join(files, file).withColumn("piece", got).withColumn("short_read", F.length("piece") < F.col("length")).drop("content")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of files matching a glob, with the file name."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "content", F.sha2("content", 256).alias("sha256"))

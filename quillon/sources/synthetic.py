"""Seeded synthetic fields and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gaussian(spark: SparkSession, tensor: str, rows: int, channels: int, seed: int) -> DataFrame:
    """A matrix of standard normal values, the same on every run and partitioning: Box-Muller over hashes of the position."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    value = F.sqrt(-2 * F.ln(unit(0))) * F.cos(2 * F.pi() * unit(1))
    return spark.range(rows * channels).select(F.lit(tensor).alias("tensor_id"), F.col("id").alias("pos"), F.call_function("div", F.col("id"), F.lit(channels).cast("bigint")).alias("row_id"), F.pmod("id", F.lit(channels)).cast("int").alias("channel"), value.cast("float").alias("value"))


def channel_outliers(elements: DataFrame, n: int = 8, scale: float = 40.0) -> DataFrame:
    """The first n channels times scale."""
    return elements.withColumn("value", F.when(F.col("channel") < n, F.col("value") * F.lit(scale).cast("float")).otherwise(F.col("value")).cast("float"))


def ramp(spark: SparkSession, n: int, period: int = 977) -> DataFrame:
    """pos, value: 1 to period, repeating."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.pmod("id", F.lit(period)) + 1).alias("value"))

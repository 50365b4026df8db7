"""Configuration grids, best and frozen choices, and knob checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def config_grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """The product of small literal axes."""
    parts = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in axes.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def tag(settings: Column) -> Column:
    """A map of settings as key=value text in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def best_by_tag(rows: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """The largest (score, label): equal scores go to the last label."""
    return rows.groupBy(*keys).agg(F.max(F.struct(score, label)).alias("best")).select(*keys, F.col(f"best.{label}").alias("best_label"), F.col(f"best.{score}").alias("best_score"))


def first_best(rows: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The first row with the largest score."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def best_against_fixed(rows: DataFrame, keys: list[str], label: str, score: str, fixed: str) -> DataFrame:
    """How the best choice of each key compares with one fixed label: wins and gains."""
    best = best_by_tag(rows, keys, score, label)
    base = rows.where(F.col(label) == fixed).groupBy(*keys).agg(F.max(score).alias("fixed_score"))
    both = best.join(base, keys).withColumn("gain", F.col("best_score") / F.nullif(F.col("fixed_score"), F.lit(0.0)))
    return both.agg(F.count("*").alias("cells"), F.count_if(F.col("best_label") == fixed).alias("fixed_wins"), F.avg("gain").alias("mean_gain"), F.min("gain").alias("min_gain"), F.max("gain").alias("max_gain"))


def frozen_choice(rows: DataFrame, label: str, score: str, n: int = 8) -> DataFrame:
    """The n labels with the best mean score (ties: by label), ranked. One row per label is ranked."""
    means = rows.groupBy(label).agg(F.avg(score).alias("mean_score"), F.count("*").alias("cells")).orderBy(F.desc("mean_score"), label).limit(n)
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_score"), label)))


def tags_distinct(rows: DataFrame, label: str) -> DataFrame:
    """Whether no tag of a grid occurs twice."""
    return rows.agg(F.count(label).alias("n"), F.count_distinct(label).alias("distinct_n")).withColumn("ok", F.col("n") == F.col("distinct_n"))

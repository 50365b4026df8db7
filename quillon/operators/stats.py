"""Tensor statistics, axis predictability and spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import count_quantile, is_finite

#: An outlier is above 4 deviations, a near-zero below a hundredth of one.
OUTLIER, NEAR_ZERO = 4.0, 0.01


def difference(value: str, keys: list[str], order: str) -> Column:
    """value minus its predecessor along one axis."""
    return F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))


def tensor_stats(elements: DataFrame) -> DataFrame:
    """Moments, range, outlier and near-zero shares and the deviation of adjacent differences.

    A deviation of 0 gives the shares 0 and 1 and the ratio 0."""
    v = F.col("value").cast("double")
    diffed = elements.withColumn("value", v).withColumn("diff", difference("value", ["tensor_id", "row_id"], "channel"))
    base = diffed.groupBy("tensor_id").agg(
        F.count("*").alias("n"), F.stddev_samp("value").alias("std"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("range"),
        F.max(F.abs("value")).alias("absmax"), F.stddev_samp("diff").alias("adjdiff_std"), F.count_if(~is_finite("value")).alias("nonfinite"),
    )
    shares = diffed.join(base.select("tensor_id", "std"), "tensor_id").groupBy("tensor_id").agg(
        F.avg((F.abs("value") > OUTLIER * F.col("std")).cast("int")).alias("outliers"),
        F.avg((F.abs("value") < NEAR_ZERO * F.col("std")).cast("int")).alias("near_zeros"),
    )
    out = base.join(shares, "tensor_id")
    flat = F.col("std") == 0
    return out.select(
        "tensor_id", "n", "std", "mean", "range", "absmax", "adjdiff_std", "nonfinite",
        F.when(flat, 0.0).otherwise(F.col("outliers")).alias("outlier_rate"),
        F.when(flat, 1.0).otherwise(F.col("near_zeros")).alias("near_zero_frac"),
        F.when(flat, 0.0).otherwise(F.col("adjdiff_std") / F.nullif(F.col("std"), F.lit(0.0))).alias("adjdiff_over_std"),
    )


def axis_predictability(elements: DataFrame, axes: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Per tensor and axis: deviation of adjacent differences over the deviation of the values
    (square root of 2 for white noise). axes: name to (keys held fixed, axis column)."""
    v = elements.withColumn("value", F.col("value").cast("double"))
    for name, (keys, order) in axes.items():
        v = v.withColumn(f"diff_{name}", difference("value", ["tensor_id", *keys], order))
    stds = [(F.stddev_pop(f"diff_{n}") / F.nullif(F.stddev_pop("value"), F.lit(0.0))).alias(n) for n in axes]
    return v.groupBy("tensor_id").agg(*stds)


def scale_spread(elements: DataFrame, axis: str) -> DataFrame:
    """Spread of the scales (largest magnitudes) along an axis: max / median, and deviation / mean."""
    scales = elements.groupBy("tensor_id", axis).agg(F.max(F.abs(F.col("value").cast("double"))).alias("scale"))
    m = F.median("scale")
    return scales.groupBy("tensor_id").agg((F.max("scale") / F.nullif(m, F.lit(0.0))).alias("max_over_median"), (F.stddev_pop("scale") / F.nullif(F.avg("scale"), F.lit(0.0))).alias("cv"))


def variance_within_between(samples: DataFrame, cell: list[str], process: str, value: str) -> DataFrame:
    """Per cell: median coefficient of variation inside processes, that of the process medians, and
    their largest over smallest."""
    per = samples.groupBy(*cell, process).agg(F.median(value).alias("mid"), (F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"))
    return per.groupBy(*cell).agg(F.count("*").alias("processes"), F.median("cv").alias("cv_within"), (F.stddev_pop("mid") / F.nullif(F.avg("mid"), F.lit(0.0))).alias("cv_between"), (F.max("mid") / F.nullif(F.min("mid"), F.lit(0.0))).alias("spread"))


def quartile_summary(rows: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    """Quartiles at n // 4 and 3n // 4 of the sorted values, extremes and the count at or above floor."""
    return rows.groupBy(*keys).agg(F.min(value).alias("least"), count_quantile(value, 1, 4).alias("q1"), F.median(value).alias("mid"), count_quantile(value, 3, 4).alias("q3"), F.max(value).alias("most"), F.count_if(F.col(value) >= floor).alias("above"))


def distinct_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Whether a knob changes the result: distinct values, and their spread in percent of the least."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("distinct_values"), ((F.max(value) - F.min(value)) / F.nullif(F.min(value), F.lit(0)) * 100).alias("spread_pct")).withColumn("reachable", F.col("distinct_values") > 1)

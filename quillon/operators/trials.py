"""Paired timing trials: ratios, verdicts, overlap and stage breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import col, from_end, index_quantile


def geometric_ratio(compressed, raw) -> Column:
    """exp(mean(ln(compressed / raw))) as an aggregate; pairs that are not positive do not count."""
    pair = F.when((col(raw) > 0) & (col(compressed) > 0), F.ln(col(compressed) / col(raw)))
    return F.exp(F.avg(pair))


def paired_summary(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Medians, index quartiles of the ratio and the geometric mean ratio per key."""
    r = F.col("compressed_s") / F.nullif(F.col("raw_s"), F.lit(0.0))
    return trials.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.median("raw_s").alias("raw_median_s"), F.median("compressed_s").alias("compressed_median_s"),
        index_quantile(r, 0.25).alias("ratio_q25"), index_quantile(r, 0.75).alias("ratio_q75"), geometric_ratio("compressed_s", "raw_s").alias("ratio"),
    )


def ratio_rollup(trials: DataFrame, keys: list[str], segment: str) -> DataFrame:
    """The ratio per key and segment, and over all segments (a null segment)."""
    parts = trials.groupBy(*keys, segment).agg(geometric_ratio("compressed_s", "raw_s").alias("ratio"), F.count("*").alias("pairs"))
    whole = trials.groupBy(*keys).agg(geometric_ratio("compressed_s", "raw_s").alias("ratio"), F.count("*").alias("pairs"))
    return parts.unionByName(whole.withColumn(segment, F.lit(None).cast(trials.schema[segment].dataType)))


def ratio_verdict(low, high) -> Column:
    """What an interval of the ratio compressed / raw says."""
    return F.when(col(high) < 1, "faster").when((col(low) < 1) & (col(high) > 1), "undetermined").otherwise("slower")


def crosses_zero(low, high) -> Column:
    return (col(low) < 0) & (col(high) > 0)


def control_gate(measured, reference) -> Column:
    """Strictly within 15 % of the reference."""
    r = col(measured) / F.nullif(col(reference), F.lit(0.0))
    return (r > 0.85) & (r < 1.15)


def overlap_efficiency(a, b, together) -> Column:
    """1 when the shorter of two activities is hidden completely, 0 when they run one after the other."""
    return 1 - (col(together) - F.greatest(col(a), col(b))) / F.nullif(F.least(col(a), col(b)), F.lit(0.0))


def overlap_share(a, b, together) -> Column:
    return (col(a) + col(b) - col(together)) / F.nullif(F.least(col(a), col(b)), F.lit(0.0))


def overlap_verdict(a, b, together) -> Column:
    """Consistent measurements only: together must not be clearly shorter than the longer one."""
    e = overlap_efficiency(a, b, together)
    return F.when(col(together) < 0.9 * F.greatest(col(a), col(b)), "inconsistent").when(e >= 0.85, "overlaps").when(e <= 0.10, "serial").otherwise("partial")


def stage_breakdown(samples: DataFrame, keys: list[str], stage: str, seconds: str) -> DataFrame:
    """Median per stage, its share of the sum of medians, and the running sum over stages by name."""
    mids = samples.groupBy(*keys, stage).agg(F.median(seconds).alias("median_s"))
    over = Window.partitionBy(*keys)
    return mids.withColumn("share", F.col("median_s") / F.nullif(F.sum("median_s").over(over), F.lit(0.0))).withColumn("upto_s", F.sum("median_s").over(over.orderBy(stage).rowsBetween(Window.unboundedPreceding, 0)))


def host_residual(samples: DataFrame, keys: list[str], stage: str, seconds: str, total: str) -> DataFrame:
    """Median total less the sum of the other stages' medians."""
    mids = samples.groupBy(*keys, stage).agg(F.median(seconds).alias("m"))
    return mids.groupBy(*keys).agg(F.sum(F.when(F.col(stage) != total, F.col("m"))).alias("stages_s"), F.max(F.when(F.col(stage) == total, F.col("m"))).alias("total_s")).withColumn("residual_s", F.col("total_s") - F.col("stages_s"))


def bandwidth(samples: DataFrame, keys: list[str], nbytes: str, seconds: str) -> DataFrame:
    """GB/s of the median, ms per call, and the second largest time as a rough 95th percentile."""
    mid = F.median(seconds)
    return samples.groupBy(*keys).agg((F.max(nbytes) / 1e9 / F.nullif(mid, F.lit(0.0))).alias("gbps"), (mid * 1e3).alias("ms"), (from_end(seconds, 2) * 1e3).alias("p95_ms"))


def exclusive_offsets(rows: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """rows with the offset at which each starts in its file."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def bound_by(waits: DataFrame, keys: list[str], stage: str, busy: str) -> DataFrame:
    """The stage with the largest median busy time; ties go to the first name."""
    mids = waits.groupBy(*keys, stage).agg(F.median(busy).alias("busy_s"))
    w = Window.partitionBy(*keys).orderBy(F.desc("busy_s"), stage)
    return mids.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def balanced_order(rows: DataFrame, keys: list[str], unit: str, seed: int) -> DataFrame:
    """rows with arm_first: half of the units of each key, drawn by a hash, start with the raw arm."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), unit), unit)
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("draw", F.row_number().over(w)).withColumn("raw_first", F.col("draw") <= F.floor(n / 2)).drop("draw")

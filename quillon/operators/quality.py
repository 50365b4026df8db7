"""Per-token scores of documents under several arms: deltas, contrasts and alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def document_scores(tokens: DataFrame) -> DataFrame:
    """doc, arm: summed and mean negative log-likelihood and number of tokens."""
    return tokens.groupBy("doc", "arm").agg(F.sum("nll").alias("nll_sum"), F.count("nll").alias("ntok"), F.avg("nll").alias("mean_nll"))


def deltas(scores: DataFrame, baseline: str) -> DataFrame:
    """Each document's mean per arm less its own baseline."""
    base = scores.where(F.col("arm") == baseline).select("doc", F.col("mean_nll").alias("base_nll"))
    return scores.where(F.col("arm") != baseline).join(base, "doc").withColumn("delta", F.col("mean_nll") - F.col("base_nll"))


def delta_summary(rows: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per arm: documents, mean and largest delta, how many are worse, and percent perplexity."""
    mean = F.avg("delta")
    return rows.groupBy("arm").agg(F.count("*").alias("docs"), mean.alias("mean_delta"), F.max("delta").alias("max_delta"), F.count_if(F.col("delta") > tolerance).alias("worse"), (100 * (F.exp(mean) - 1)).alias("ppl_pct"))


def arm_totals(scores: DataFrame) -> DataFrame:
    """Token-weighted mean and perplexity per arm."""
    mean = F.sum("nll_sum") / F.nullif(F.sum("ntok"), F.lit(0))
    return scores.groupBy("arm").agg(mean.alias("mean_nll"), F.exp(mean).alias("ppl"), F.sum("ntok").alias("ntok"))


def contrast_2x2(scores: DataFrame, both: str, first: str, second: str, none: str) -> DataFrame:
    """Interaction per document: both - first - second + none."""
    arms = [both, first, second, none]
    wide = scores.groupBy("doc").pivot("arm", arms).agg(F.max("mean_nll"))
    complete = reduce(lambda a, b: a & b, [F.col(f"`{a}`").isNotNull() for a in arms])
    value = F.col(f"`{both}`") - F.col(f"`{first}`") - F.col(f"`{second}`") + F.col(f"`{none}`")
    return wide.where(complete).select("doc", value.alias("interaction"))


def shift_test(series: DataFrame, keys: list[str], order: list[str], a: str, b: str, shifts: range = range(-2, 3)) -> DataFrame:
    """Per key and shift k: mean |a[t] - b[t + k]| over the places that both have, and whether it is
    the least (ties: the first shift)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    moved = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("shift"), F.abs(F.col(a) - F.lead(b, k).over(w)).alias("diff")) for i, k in enumerate(shifts)])
    rows = series.select(*keys, moved.alias("moved")).select(*keys, F.explode("moved").alias("m")).select(*keys, "m.*").where("diff IS NOT NULL")
    means = rows.groupBy(*keys, "ord", "shift").agg(F.avg("diff").alias("mean_abs_diff"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("mean_abs_diff", "ord"))
    return means.withColumn("best", first == 1).drop("ord")


def compare_tokens(a: DataFrame, b: DataFrame, keys: list[str], large: float = 0.1) -> DataFrame:
    """Absolute differences of two scorings of the same tokens: mean, median, largest, how many large, mean gap."""
    both = a.join(b.withColumnRenamed("nll", "other"), [*keys, "pos"]).withColumn("diff", F.abs(F.col("nll") - F.col("other")))
    return both.groupBy(*keys).agg(F.avg("diff").alias("mean_abs"), F.median("diff").alias("median_abs"), F.max("diff").alias("max_abs"), F.count_if(F.col("diff") > large).alias("large"), F.abs(F.avg(F.col("nll") - F.col("other"))).alias("mean_gap"))


def preflight(identical: DataFrame, cached: DataFrame) -> DataFrame:
    """Gates over two joins (doc, nll, other): a bit-identical replacement may not move a score by more
    than 1e-6; a gap between cached and full scoring over 1e-3 calls for a look."""
    gap = F.max(F.abs(F.col("nll") - F.col("other")))
    x, y = identical.agg(gap.alias("replacement_gap")), cached.agg(gap.alias("cached_gap"))
    return x.crossJoin(y).select("replacement_gap", "cached_gap", (F.col("replacement_gap") <= 1e-6).alias("ok"), (F.col("cached_gap") > 1e-3).alias("investigate"))


def dtype_verdict(gaps: DataFrame, low: str = "bf16", high: str = "fp32") -> DataFrame:
    """Ratio of the mean gaps of two types, and whether any shift but 0 was best."""
    of = lambda t: F.avg(F.when(F.col("dtype") == t, F.col("mean_gap")))
    return gaps.agg((of(low) / F.nullif(of(high), F.lit(0.0))).alias("gap_ratio"), F.bool_or(F.col("best_shift") != 0).alias("shift_helps"))


def next_token_targets(tokens: DataFrame, doc: str, pos: str, token: str) -> DataFrame:
    """tokens with the target that each place predicts (null at the end of a document)."""
    return tokens.withColumn("target", F.lead(token).over(Window.partitionBy(doc).orderBy(pos)))

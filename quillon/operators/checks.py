"""Delivery checks, fault injection and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import is_finite
from .codec import TOLERANCE

FAULTS = ("nan", "pos_inf", "neg_inf", "over_bound", "bit_flip", "truncated")


def inject(elements: DataFrame, fault: str, eps: float) -> DataFrame:
    """elements (tensor_id, pos, value, delivered) with one fault per tensor in delivered."""
    at = F.col("pos") == 0
    new = {
        "nan": F.when(at, float("nan")), "pos_inf": F.when(at, float("inf")), "neg_inf": F.when(at, float("-inf")),
        "over_bound": F.when(at, F.col("value") + F.lit(4 * eps + 1e-3)),
        # the sign and the top exponent bit: the value doubles in magnitude class and changes sign
        "bit_flip": F.when(at, -F.col("delivered") * 2.0**64 - 1.0),
    }
    if fault == "truncated":
        half = elements.groupBy("tensor_id").agg(F.floor(F.count("*") / 2).alias("half"))
        return elements.join(half, "tensor_id").withColumn("delivered", F.when(F.col("pos") < F.col("half"), F.col("delivered"))).drop("half")
    return elements.withColumn("delivered", F.coalesce(new[fault], F.col("delivered")).cast("double"))


def validate(elements: DataFrame, eps: float) -> DataFrame:
    """Per tensor: missing and not finite values, largest error, and whether all is well."""
    err = F.max(F.when(is_finite("delivered"), F.abs(F.col("value") - F.col("delivered"))))
    out = elements.groupBy("tensor_id").agg(F.count_if(F.col("delivered").isNull()).alias("missing"), F.count_if(F.col("delivered").isNotNull() & ~is_finite("delivered")).alias("nonfinite"), F.coalesce(err, F.lit(0.0)).alias("max_err"))
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("nonfinite") == 0) & (F.col("max_err") <= eps + TOLERANCE))


def fault_suite(elements: DataFrame, eps: float) -> DataFrame:
    """Each fault and no fault: tensors, and how many the validation rejects."""
    out = None
    for fault in (None, *FAULTS):
        rows = validate(elements if fault is None else inject(elements, fault, eps), eps)
        part = rows.agg(F.lit(fault or "none").alias("fault"), F.count("*").alias("tensors"), F.count_if(~F.col("ok")).alias("rejected"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("detected", F.when(F.col("fault") == "none", F.col("rejected") == 0).otherwise(F.col("rejected") == F.col("tensors")))


def delivery(source: DataFrame, delivered: DataFrame, key: str, content: str) -> DataFrame:
    """Byte checks by ordinal: lengths, short reads and equality."""
    b = delivered.select(key, F.col(content).alias("got"))
    both = source.join(b, key, "left")
    return both.select(key, F.length(content).alias("expected"), F.coalesce(F.length("got"), F.lit(0)).alias("read"), (F.coalesce(F.length("got"), F.lit(0)) < F.length(content)).alias("short_read"), F.col("got").eqNullSafe(F.col(content)).alias("exact"))


def reuse_counters(fresh: DataFrame, reused: DataFrame, keys: list[str]) -> DataFrame:
    """How often a reused buffer gave other values than a fresh one."""
    r = reused.select(*keys, F.col("fp32").alias("r32"), F.col("bf16").alias("r16"))
    both = r.join(fresh, keys)
    off32, off16 = ~F.col("r32").eqNullSafe(F.col("fp32")), ~F.col("r16").eqNullSafe(F.col("bf16"))
    return both.agg(F.count("*").alias("n"), F.count_if(off32).alias("fp32_differs"), F.count_if(off16).alias("bf16_differs"), F.count_if(off32 | off16).alias("either_differs"), F.count_if(~is_finite("r32")).alias("nonfinite"))


def gate(checks: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """All and any of a flag per key."""
    return checks.groupBy(*keys).agg(F.count("*").alias("checks"), F.bool_and(flag).alias("all_ok"), F.bool_or(flag).alias("any_ok"), F.count_if(~F.col(flag)).alias("failing"))


def exact_and_zero(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Shares of equal and of zero places."""
    return rows.groupBy(*keys).agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("exact"), F.avg((F.col(a) == 0).cast("int")).alias("zero"))


def modes_identical(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells in which all modes gave one value."""
    return rows.groupBy(*keys).agg((F.count_distinct(value) == 1).alias("same")).agg(F.count("*").alias("cells"), F.count_if("same").alias("identical"))


def violations(rows: DataFrame, keys: list[str], error: str, bound: str) -> DataFrame:
    """Per key: rows, how many are over their bound, and the worst error / bound."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(error) > F.col(bound) + TOLERANCE).alias("over"), F.max(F.col(error) / F.nullif(F.col(bound), F.lit(0.0))).alias("worst"))

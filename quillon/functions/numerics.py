"""Numeric column expressions with the exact rounding rules that error bounds depend on.

Spark divides floats in double precision, so float32 division is a double division cast back;
`round` is half-up, so half-even rounding is `rint`; `floor(log2(x))` can be one off at powers of
two, so the binary exponent is corrected against the neighbouring powers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stored mantissa bits and smallest normal exponent of the emulated types.
MANTISSA = {"bf16": 7, "fp16": 10}
LEAST_EXPONENT = {"bf16": -126, "fp16": -14}
ELEMENT_BYTES = {"bf16": 2, "fp16": 2, "fp32": 4}
#: Smallest magnitude for which a unit in the last place is taken.
TINY = 1e-30


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def is_finite(x) -> Column:
    """Neither null, NaN nor infinite."""
    x = col(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def exponent(x) -> Column:
    """floor(log2(x)) of a positive number, exact at powers of two."""
    x = col(x).cast("double")
    e = F.floor(F.log2(x))
    two = F.lit(2.0)
    return e + F.when(F.pow(two, e + 1) <= x, 1).when(F.pow(two, e) > x, -1).otherwise(0)


def round_to(x, dtype: str) -> Column:
    """x rounded half-even to bf16 or fp16 precision, as a float; fp32 only casts."""
    x = col(x).cast("float")
    if dtype == "fp32":
        return x
    e = F.greatest(exponent(F.abs(x)), F.lit(LEAST_EXPONENT[dtype]))
    step = F.pow(F.lit(2.0), (e - MANTISSA[dtype]).cast("double"))
    rounded = (F.rint(x.cast("double") / step) * step).cast("float")
    if dtype == "fp16":
        rounded = F.when(F.abs(rounded) > 65504, F.signum(rounded) * float("inf")).otherwise(rounded).cast("float")
    return F.when(is_finite(x) & (x != 0), rounded).otherwise(x)


def half_ulp(magnitude, dtype: str) -> Column:
    """Half a unit in the last place at a magnitude; 0 for fp32, which is not rounded again."""
    if dtype == "fp32":
        return F.lit(0.0)
    return F.pow(F.lit(2.0), (exponent(F.greatest(col(magnitude).cast("double"), F.lit(TINY))) - MANTISSA[dtype] - 1).cast("double"))


def divide32(a, b) -> Column:
    """Float32 division, also under ANSI mode; null where b is 0."""
    b = col(b).cast("double")
    return (F.when(b != 0, col(a).cast("double") / b)).cast("float")


def clamp(x, low, high) -> Column:
    return F.greatest(col(low), F.least(col(high), col(x)))


def packed_bytes(n, width) -> Column:
    """Bytes of n codes of `width` bits."""
    return F.call_function("div", col(n) * col(width) + 7, F.lit(8).cast("bigint"))


def ratio(original, compressed) -> Column:
    return col(original) / F.greatest(col(compressed), F.lit(1))


def index_quantile(x, fraction: float) -> Column:
    """The sorted value at int(fraction * (n - 1)), as an aggregate."""
    v = F.array_sort(F.collect_list(col(x)))
    return F.get(v, F.floor(F.lit(fraction) * (F.size(v) - 1)).cast("int"))


def from_end(x, k: int) -> Column:
    """The k-th largest value (k = 2: the second), as an aggregate; null if there are fewer."""
    v = F.array_sort(F.collect_list(col(x)))
    return F.get(v, F.size(v) - k)


def count_quantile(x, num: int, den: int) -> Column:
    """The sorted value at num * n // den, as an aggregate."""
    v = F.array_sort(F.collect_list(col(x)))
    return F.get(v, F.floor(F.size(v) * num / den).cast("int"))


def linear_quantile(x, fraction: float) -> Column:
    return F.percentile(col(x), F.lit(fraction))


def log_space(low: float, high: float, n: int) -> Column:
    """n values from low to high, evenly spaced in the logarithm, as an array."""
    import math

    a, b = math.log10(low), math.log10(high)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pow(F.lit(10.0), F.lit(a) + i * (b - a) / max(n - 1, 1)))


def log_sum_exp(x: Column) -> Column:
    """log(sum(exp)) of an array, shifted by its maximum."""
    m = F.array_max(x)
    return F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m))) + m


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log-likelihood of the target's place (from 0) under the logits."""
    return log_sum_exp(logits) - F.get(logits, target)


def short_hash(x) -> Column:
    """The first 16 hex digits of SHA-1."""
    return F.substring(F.sha1(col(x).cast("binary")), 1, 16)


def squeeze_spaces(x) -> Column:
    """Runs of Unicode white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))

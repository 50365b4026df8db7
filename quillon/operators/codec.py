"""The error-bounded group codec over long tensors.

Elements are put into budget groups (block, channel or token). Per group: bounds, a bit width under
which the error budget holds (or 0: stored raw), a float32 scale, codes rounded half-even, and a
realised error; a group over its bound is stored raw after all, so the bound never fails. Both
passes group by (tensor, group), so the join back to the elements and the second aggregation share
one partitioning. Sizes are 9 bytes of metadata per group plus packed codes or raw elements.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import ELEMENT_BYTES, clamp, divide32, half_ulp, is_finite, packed_bytes, round_to

WIDTHS = (4, 6, 8)
ALLOCATIONS = ("blockwise", "per_channel", "per_token")
#: Metadata bytes of a group, the absolute tolerance of the bound, the floor of an int8 scale.
GROUP_BYTES, TOLERANCE, INT8_FLOOR = 9, 1e-6, 1e-30


@dataclass(frozen=True)
class CodecConfig:
    eps: float
    allocation: str = "blockwise"
    block_size: int = 256
    bit_width: int | None = None
    dtype: str = "bf16"

    def __post_init__(self):
        if not self.eps > 0:
            raise ValueError("eps must be positive")
        if self.bit_width is not None and self.bit_width not in WIDTHS:
            raise ValueError(f"bit_width must be one of {WIDTHS}")
        if self.allocation not in ALLOCATIONS:
            raise ValueError(f"allocation must be one of {ALLOCATIONS}")
        if self.dtype not in ELEMENT_BYTES:
            raise ValueError(f"dtype must be one of {tuple(ELEMENT_BYTES)}")


def group_id(allocation: str, block_size: int, pos: str = "pos", channels=None) -> Column:
    """The budget group of a position; without channels (rank below 2) every allocation is blockwise."""
    if allocation == "blockwise" or channels is None:
        return F.call_function("div", F.col(pos), F.lit(block_size).cast("bigint"))
    c = (F.col(channels) if isinstance(channels, str) else F.lit(channels)).cast("bigint")
    return F.pmod(F.col(pos), c) if allocation == "per_channel" else F.call_function("div", F.col(pos), c)


def with_groups(elements: DataFrame, cfg: CodecConfig, channels=None) -> DataFrame:
    """elements with group_id, value rounded to the dtype, and whether it is finite."""
    rows = elements.withColumn("value", round_to("value", cfg.dtype)).withColumn("group_id", group_id(cfg.allocation, cfg.block_size, "pos", channels))
    return rows.withColumn("finite", is_finite("value"))


def group_bounds(grouped: DataFrame) -> DataFrame:
    """n, gmin, gmax, range, nonfinite per (tensor_id, group_id); values that are not finite count as 0."""
    v = F.when(F.col("finite"), F.col("value")).otherwise(F.lit(0.0).cast("float"))
    out = grouped.groupBy("tensor_id", "group_id").agg(F.count("*").alias("n"), F.min(v).alias("gmin"), F.max(v).alias("gmax"), F.bool_or(~F.col("finite")).alias("nonfinite"))
    return out.withColumn("range", (F.col("gmax") - F.col("gmin")).cast("float"))


def adaptive_width(rng: Column, budget: Column) -> Column:
    """The least of 4, 6, 8 bits with range / (2 * budget) + 1 <= 2**w; 0 if none."""
    levels = F.when(budget > 0, rng.cast("double") / (2 * budget) + 1)
    out = F.when(budget <= 0, 0)
    for w in WIDTHS:
        out = out.when(levels <= float(2**w), w)
    return out.otherwise(0)


def fixed_width(rng: Column, budget: Column, width: int) -> Column:
    """width where half a step of it is within the budget; else 0."""
    return F.when((budget > 0) & (rng.cast("double") / (2**width - 1) / 2 <= budget), width).otherwise(0)


def plan_groups(bounds: DataFrame, cfg: CodecConfig) -> DataFrame:
    """bounds with budget, width and scale; the bound is the column eps where bounds have one."""
    budget = (F.col("eps") if "eps" in bounds.columns else F.lit(cfg.eps)) - half_ulp(F.greatest(F.abs("gmin"), F.abs("gmax")), cfg.dtype)
    out = bounds.withColumn("budget", budget)
    chosen = adaptive_width(F.col("range"), F.col("budget")) if cfg.bit_width is None else fixed_width(F.col("range"), F.col("budget"), cfg.bit_width)
    out = out.withColumn("width", F.when(F.col("nonfinite"), 0).otherwise(chosen))
    steps = F.pow(F.lit(2.0), F.col("width").cast("double")) - 1
    return out.withColumn("scale", F.coalesce(F.when((F.col("width") > 0) & (F.col("range") > 0), divide32("range", steps)), F.lit(0.0).cast("float")))


def quantise(elements: DataFrame, dtype: str) -> DataFrame:
    """elements joined with their group's plan, with code, restored value and error."""
    q = F.rint(divide32((F.col("value") - F.col("gmin")).cast("float"), F.col("scale")).cast("double"))
    top = (F.pow(F.lit(2.0), F.col("width").cast("double")) - 1).cast("int")
    code = F.when((F.col("scale") > 0) & F.col("finite"), clamp(q.cast("int"), F.lit(0), top)).otherwise(0)
    rows = elements.withColumn("code", code)
    restored = round_to((F.col("gmin") + (F.col("code").cast("float") * F.col("scale")).cast("float")).cast("float"), dtype)
    rows = rows.withColumn("restored", F.when(F.col("width") == 0, F.col("value")).otherwise(restored))
    return rows.withColumn("err", F.when(F.col("finite"), F.abs(F.col("value").cast("double") - F.col("restored").cast("double"))))


@dataclass
class Encoded:
    elements: DataFrame  # with group plan, code, restored, err
    groups: DataFrame  # one row per group, after the bound check
    cfg: CodecConfig


def encode(elements: DataFrame, cfg: CodecConfig, channels=None, eps: DataFrame | None = None) -> Encoded:
    """Quantise under the bound; groups that fail the check are stored raw. eps: tensor_id, eps of
    tensors with a bound of their own; others have the bound of cfg."""
    grouped = with_groups(elements, cfg, channels)
    bounds = group_bounds(grouped)
    if eps is not None:
        own = eps.select("tensor_id", F.col("eps").cast("double").alias("own_eps"))
        bounds = bounds.join(own, "tensor_id", "left").withColumn("eps", F.coalesce("own_eps", F.lit(cfg.eps))).drop("own_eps")
    plan = plan_groups(bounds, cfg)
    keys = ["tensor_id", "group_id"]
    coded = quantise(grouped.join(plan.select(*keys, "gmin", "scale", "width"), keys), cfg.dtype)
    realised = coded.groupBy(*keys).agg(F.coalesce(F.max("err"), F.lit(0.0)).alias("max_err"))
    groups = plan.join(realised, keys)
    failed = F.col("max_err") > (F.col("eps") if eps is not None else F.lit(cfg.eps)) + TOLERANCE
    groups = groups.withColumn("demoted", failed & (F.col("width") > 0)).withColumn("width", F.when(failed, 0).otherwise(F.col("width"))).withColumn("max_err", F.when(F.col("width") == 0, F.lit(0.0)).otherwise(F.col("max_err")))
    elem = ELEMENT_BYTES[cfg.dtype]
    groups = groups.withColumn("bytes", GROUP_BYTES + F.when(F.col("width") == 0, F.col("n") * elem).otherwise(packed_bytes("n", "width")))
    return Encoded(coded, groups, cfg)


def results(encoded: Encoded) -> DataFrame:
    """One row per tensor: sizes, width, error, counters and bypass reason."""
    cfg, elem = encoded.cfg, ELEMENT_BYTES[encoded.cfg.dtype]
    packed = F.when(F.col("width") > 0, F.col("width"))
    out = encoded.groups.groupBy("tensor_id").agg(
        F.sum(F.col("n") * elem).alias("original_bytes"),
        F.sum("bytes").alias("packed_bytes"),
        F.when(F.count_distinct(packed) == 1, F.max(packed)).otherwise(-1).alias("bit_width"),
        F.max("max_err").alias("max_abs_error"),
        F.count_if("nonfinite").alias("nonfinite_blocks"),
        F.count("*").alias("total_blocks"),
        (100 * F.avg((F.col("width") == 0).cast("int"))).alias("raw_pct"),
    )
    tiny = F.col("original_bytes") < cfg.block_size * elem
    out = out.withColumn("bypass_reason", F.when(tiny, "tensor_too_small").otherwise("none"))
    out = out.withColumn("compressed_bytes", F.when(tiny, F.col("original_bytes")).otherwise(F.col("packed_bytes")))
    out = out.withColumn("raw_pct", F.when(tiny, 100.0).otherwise(F.col("raw_pct"))).withColumn("ratio", F.col("original_bytes") / F.greatest("compressed_bytes", F.lit(1)))
    return out.withColumn("nonfinite_block_rate", F.col("nonfinite_blocks") / F.greatest("total_blocks", F.lit(1))).drop("packed_bytes")


def decode(encoded: Encoded) -> DataFrame:
    """tensor_id, pos, value as a reader restores them: raw groups bit for bit, others from codes."""
    final = encoded.groups.select("tensor_id", "group_id", F.col("width").alias("kept_width"))
    rows = encoded.elements.join(final, ["tensor_id", "group_id"])
    return rows.select("tensor_id", "pos", F.when(F.col("kept_width") == 0, F.col("value")).otherwise(F.col("restored")).alias("value"))


def bypass_reason(dtype: Column, contiguous: Column, numel: Column, block_size: int) -> Column:
    """Why a tensor is passed through, first match first: type, layout, size; null if it is not."""
    return F.when(~dtype.isin(*ELEMENT_BYTES), "dtype").when(~contiguous, "not_contiguous").when(numel < block_size, "tensor_too_small")


def relative_eps(elements: DataFrame, factors: list[float]) -> DataFrame:
    """tensor_id, c, eps = c * sample standard deviation; an error where that is not positive."""
    std = elements.groupBy("tensor_id").agg(F.stddev_samp("value").alias("std"))
    checked = std.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.raise_error(F.lit("standard deviation must be positive")).cast("double")))
    return checked.withColumn("c", F.explode(F.array(*map(F.lit, factors)))).select("tensor_id", "c", (F.col("c") * F.col("std")).cast("float").alias("eps"))


def int8_baseline(elements: DataFrame, per_channel: bool) -> DataFrame:
    """Symmetric int8 per tensor or channel: ratio against two-byte elements, and largest error."""
    keys = ["tensor_id", "channel"] if per_channel else ["tensor_id"]
    rows = elements.withColumn("value", round_to("value", "bf16"))
    top = rows.groupBy(*keys).agg(F.max(F.abs("value")).alias("top"))
    top = top.withColumn("scale", F.greatest(divide32("top", F.lit(127.0)), F.lit(INT8_FLOOR).cast("float")))
    coded = rows.join(top, keys).withColumn("code", clamp(F.rint(divide32("value", "scale").cast("double")), F.lit(-127.0), F.lit(127.0)))
    coded = coded.withColumn("restored", round_to((F.col("code").cast("float") * F.col("scale")).cast("float"), "bf16"))
    err = F.max(F.abs(F.col("value").cast("double") - F.col("restored").cast("double")))
    out = coded.groupBy("tensor_id").agg(F.count("*").alias("n"), F.count_distinct("channel").alias("channels"), err.alias("max_abs_error"))
    scales = F.col("channels") if per_channel else F.lit(1)
    return out.select("tensor_id", "n", (2 * F.col("n") / (F.col("n") + 4 * scales)).alias("ratio"), "max_abs_error")


def three_way_errors(rows: DataFrame, eps: Column, keys: list[str]) -> DataFrame:
    """Errors of x (source), y (float32 restored) and z (bf16 restored) in double precision."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    out = rows.groupBy(*keys).agg(F.max(F.abs(x - y)).alias("e32"), F.max(F.abs(x - z)).alias("ebf"), F.max(F.abs(y - z)).alias("r"), F.bool_and(is_finite("y") & is_finite("z")).alias("finite"), F.max(eps).alias("eps"))
    fine = F.col("finite")
    return out.select(
        *keys, "e32", "ebf", "r", "finite",
        (fine & (F.col("e32") <= F.col("eps") + TOLERANCE)).alias("within_eps"),
        (fine & (F.col("ebf") <= F.col("eps") + TOLERANCE + F.col("r"))).alias("within_eps_plus_round"),
        (fine & (F.col("e32") <= F.col("eps") * 1.001)).alias("within_relative"),
    )


def _given(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pack_codes(codes: Column, width: int) -> Column:
    """An array of codes packed most significant bit first, the tail padded with zeros, as binary."""
    if width not in WIDTHS:
        raise ValueError(f"width must be one of {WIDTHS}")
    bits = F.array_join(F.transform(codes, lambda c: F.lpad(F.conv(c.cast("string"), 10, 2), width, "0")), "")

    def pack(b: Column) -> Column:
        size = F.floor((F.length(b) + 7) / 8).cast("int")
        byte = lambda i: F.lpad(F.conv(F.rpad(F.substring(b, i * 8 + 1, F.lit(8)), 8, "0"), 2, 16), 2, "0")
        return F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(0), size - 1), byte), "")).otherwise("")

    return F.unhex(_given(bits, pack))


def unpack_codes(packed: Column, width: int, n: Column) -> Column:
    """The n codes of a packed binary."""
    octet = lambda i: F.lpad(F.conv(F.hex(F.substring(packed, i, F.lit(1))), 16, 2), 8, "0")
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.length(packed)), octet), "")
    code = lambda b: F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.conv(F.substring(b, i * width + 1, F.lit(width)), 2, 10).cast("int"))
    return F.when(n > 0, _given(bits, code)).otherwise(F.array().cast("array<int>"))


def factor_grid(elements: DataFrame, factors: list[float]) -> tuple[DataFrame, DataFrame]:
    """(elements of one tensor per tensor and factor c, their bounds c * standard deviation): tensor_id
    is the tensor, a bar and c. The factors are a literal list."""
    name = F.concat_ws("|", "tensor_id", F.col("c").cast("string"))
    bounds = relative_eps(elements, factors).select(name.alias("tensor_id"), "eps")
    return elements.withColumn("c", F.explode(F.array(*map(F.lit, factors)))).withColumn("tensor_id", name).drop("c"), bounds


def factor_results(elements: DataFrame, factors: list[float], allocations: tuple[str, ...] = ALLOCATIONS, channels=None, **options) -> DataFrame:
    """The codec on every tensor, factor and allocation: results with tensor, c and allocation."""
    grid, bounds = factor_grid(elements, factors)
    out = None
    for a in allocations:
        part = results(encode(grid, CodecConfig(1.0, a, **options), channels, bounds)).withColumn("allocation", F.lit(a))
        out = part if out is None else out.unionByName(part)
    out = out.join(bounds, "tensor_id")
    return out.withColumn("tensor", F.substring_index("tensor_id", "|", 1)).withColumn("c", F.substring_index("tensor_id", "|", -1).cast("double")).drop("tensor_id")


def within_absolute(error: Column, eps: Column, slack: float = 1e-5) -> Column:
    """The looser absolute bound of codecs whose error is reported in single precision."""
    return error <= eps + slack


def within_rounding(error: Column, eps: Column, magnitude: Column) -> Column:
    """Within the bound and the half unit in the last place that bf16 may add at the data's magnitude."""
    return error <= eps + TOLERANCE + half_ulp(magnitude, "bf16")


#: Fixed value: the error over the bound from which data count as damaged.
DAMAGE = 1.001


def damaged(error: Column, eps: Column, finite: Column) -> Column:
    """Not finite, or an error over DAMAGE times the bound. A NaN error is damage."""
    return ~F.coalesce(finite, F.lit(False)) | F.isnan(error) | F.coalesce(error / eps > DAMAGE, F.lit(True))


def require_undamaged(rows: DataFrame, error: str, eps: str, finite: str) -> DataFrame:
    """rows, or an error when the query runs if one is damaged."""
    bad = damaged(F.col(error), F.col(eps), F.col(finite))
    return rows.withColumn(error, F.when(bad, F.raise_error(F.lit("damaged tensor")).cast("double")).otherwise(F.col(error)))


#: Which kinds of tensor a strategy compresses.
STRATEGIES = {"uniform": ("k", "v"), "k_only": ("k",), "v_only": ("v",)}


def applies(strategy: Column, kind: Column) -> Column:
    """Whether a strategy compresses tensors of a kind."""
    return F.coalesce(*[F.when(strategy == s, kind.isin(*kinds)) for s, kinds in STRATEGIES.items()], F.lit(False))


def round_trip(results_: DataFrame, cache: str) -> DataFrame:
    """Per cache: the ratio of the sums of bytes, and the largest error."""
    return results_.groupBy(cache).agg((F.sum("original_bytes") / F.sum("compressed_bytes")).alias("ratio"), F.max("max_abs_error").alias("max_abs_error"))

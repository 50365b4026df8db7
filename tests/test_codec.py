"""Bounds, golden sizes, packing and numeric rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import numerics as N
from quillon.operators import codec, stats
from quillon.sources import synthetic, wire


def np_bf16(x: np.ndarray) -> np.ndarray:
    bits = x.astype(np.float32).view(np.uint32).astype(np.uint64)
    return (((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16) << 16).astype(np.uint32).view(np.float32)


def test_bf16_rounding_matches_the_bit_trick(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 10.0 ** rng.integers(-20, 20, 2000)).astype(np.float32), np.float32([0, 1, -3e30, 65000, 1e-30, 2.0**-100, 1.00390625, 1.01171875])])
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").select("i", N.round_to("v", "bf16").alias("r")).orderBy("i").toPandas()["r"].to_numpy(np.float32)
    assert (got == np_bf16(x)).all()


def test_exponent_at_powers_of_two(spark):
    rows = spark.createDataFrame([(k, 2.0**k) for k in range(-140, 120)], "k int, v double")
    assert rows.where(N.exponent("v") != F.col("k")).count() == 0


def test_float_division_is_float32(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=500).astype(np.float32), (rng.integers(1, 256, 500)).astype(np.float32)
    got = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "i int, a float, b float").select("i", N.divide32("a", "b").alias("q")).orderBy("i").toPandas()["q"].to_numpy(np.float32)
    assert (got == a / b).all()


@pytest.mark.parametrize("width", codec.WIDTHS)
@pytest.mark.parametrize("n", [0, 1, 7, 8, 17, 255])
def test_pack_round_trip(spark, width, n):
    codes = np.random.default_rng(n).integers(0, 2**width, n).tolist()
    row = spark.createDataFrame([(codes,)], "codes array<int>").withColumn("p", codec.pack_codes(F.col("codes"), width)).select("p", codec.unpack_codes(F.col("p"), width, F.size("codes")).alias("back")).first()
    assert len(row["p"]) == -(-n * width // 8) and row["back"] == codes


def test_golden_sizes(spark):
    """64 x 2048 bf16 values in blocks of 256: raw, 6 and 8 bits."""
    field = synthetic.gaussian(spark, "g", 64, 2048, 20260902)
    size = lambda eps, w: codec.results(codec.encode(field, codec.CodecConfig(eps, bit_width=w), 2048)).first()["compressed_bytes"]
    assert size(1e-9, 8) == 266752
    assert size(0.5, 6) == 102912
    assert size(0.5, 8) == 135680


@pytest.mark.parametrize("allocation", codec.ALLOCATIONS)
@pytest.mark.parametrize("eps", [0.05, 0.15, 0.5])
def test_bound_holds(spark, allocation, eps):
    field = synthetic.channel_outliers(synthetic.gaussian(spark, "g", 16, 64, 3))
    out = codec.encode(field, codec.CodecConfig(eps, allocation), 64)
    both = codec.decode(out).join(field.select("pos", N.round_to("value", "bf16").alias("source")), "pos")
    row = both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("value").cast("double") - F.col("source").cast("double"))).alias("err")).first()
    assert row["n"] == 1024 and row["err"] <= eps + 1e-6


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_group_with_a_bad_value_is_raw_and_alone(spark, bad):
    field = synthetic.gaussian(spark, "g", 8, 256, 5).withColumn("value", F.when(F.col("pos") == 3, F.lit(bad)).otherwise(F.col("value")).cast("float"))
    groups = {r["group_id"]: r for r in codec.encode(field, codec.CodecConfig(0.15), 256).groups.collect()}
    assert groups[0]["width"] == 0 and groups[0]["nonfinite"] and all(groups[k]["width"] > 0 for k in range(1, 8))


def test_small_tensor_is_passed_through(spark):
    row = codec.results(codec.encode(synthetic.gaussian(spark, "g", 1, 3, 1), codec.CodecConfig(0.1), 3)).first()
    assert row["bypass_reason"] == "tensor_too_small" and row["ratio"] == 1


def test_constant_block_has_one_code(spark):
    field = synthetic.gaussian(spark, "g", 1, 256, 1).withColumn("value", F.lit(1.5).cast("float"))
    assert codec.encode(field, codec.CodecConfig(0.05), 256).elements.select(F.max("code"), F.max("err")).first() == (0, 0.0)


def test_config_is_validated():
    for bad in ({"eps": 0}, {"eps": 1, "bit_width": 5}, {"eps": 1, "allocation": "x"}):
        with pytest.raises(ValueError):
            codec.CodecConfig(**bad)


def test_white_noise_has_root_two(spark):
    out = stats.axis_predictability(synthetic.gaussian(spark, "g", 256, 128, 0).withColumnRenamed("channel", "ch"), {"c": (["row_id"], "ch"), "t": (["ch"], "row_id")}).first()
    assert abs(out["c"] - 2**0.5) < 0.03 and abs(out["t"] - 2**0.5) < 0.03


def test_payload_rejects_bad_magic_and_strict_raises(spark):
    rows = spark.createDataFrame([(bytearray(b"hello"),)], "body binary").withColumn("p", wire.write({"eps": F.lit(0.1)}, F.col("body")))
    bad = rows.withColumn("p", F.concat(F.lit(bytearray(b"NOPE")), F.expr("substring(p, 5, length(p))")))
    assert bad.select(wire.read(F.col("p"), strict=False)["problem"]).first()[0] == "magic"
    with pytest.raises(Exception, match="bad payload"):
        bad.select(wire.read(F.col("p"))).collect()


def test_cross_entropy_of_extreme_logits(spark):
    row = spark.createDataFrame([([1000.0, 0.0],)], "x array<double>").select(N.cross_entropy(F.col("x"), F.lit(0)).alias("a"), N.cross_entropy(F.col("x"), F.lit(1)).alias("b")).first()
    assert row["a"] == 0 and row["b"] == 1000

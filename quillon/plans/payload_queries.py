"""Queries over payload bytes and over the grids of bounds and allocations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec, payload
from ..sources import wire
from .base import ELEMENTS, bf16_sql, matrices, matrix, query, rounded, table
from .codec_queries import EPS, codec_sql

FACTORS = (0.01, 0.03, 0.1)


def _decoded(allocation: str, eps: float):
    def run(spark, sf_dir):
        cfg = codec.CodecConfig(eps, allocation)
        return payload.read(payload.write(codec.encode(matrix(spark, sf_dir), cfg, 64), 64)).select("pos", "value")

    return run


for _name, _sql, _eps in (("blockwise", "pos // 256", EPS), ("per_channel", "pos % 64", 0.01), ("per_token", "pos // 64", 0.01)):
    query(f"payload_decode_{_name}", codec_sql(_eps, _sql, None, "SELECT r.pos, CASE WHEN z.width = 0 THEN r.b ELSE r.restored END AS value FROM r JOIN z USING (group_id)"))(_decoded(_name, _eps))


@query("payload_size", codec_sql(0.004, "pos // 256", None, "SELECT CAST(sum(bytes) AS BIGINT) AS body_bytes, count(*) AS n_groups, CASE WHEN count(DISTINCT nullif(width, 0)) = 1 THEN max(nullif(width, 0)) ELSE -1 END AS bit_width, CAST(sum(n) // 64 AS INT) AS tokens FROM z"))
def payload_size(spark, sf_dir):
    made = payload.write(codec.encode(matrix(spark, sf_dir), codec.CodecConfig(0.004), 64), 64)
    got = made.select(wire.read(F.col("payload")).alias("p"))
    return got.select(F.length("p.body").cast("bigint").alias("body_bytes"), F.col("p.header.n_groups").cast("bigint").alias("n_groups"), F.col("p.header.bit_width").alias("bit_width"), F.get("p.header.original_shape", F.lit(0)).alias("tokens"))


def _row_tensors(spark, sf_dir):
    """One tensor of 64 values per vector: below the block size, so each is passed through."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("tensor_id"), F.posexplode("embedding").alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


@query("bypass_payload", f"WITH {ELEMENTS} SELECT CAST(row_id AS VARCHAR) AS tensor_id, CAST(channel AS BIGINT) AS pos, {bf16_sql('v')} AS value, CAST(0 AS INT) AS n_groups, 1.0::DOUBLE AS ratio FROM el")
def bypass_payload(spark, sf_dir):
    made = payload.write(codec.encode(_row_tensors(spark, sf_dir), codec.CodecConfig(EPS)))
    heads = made.select("tensor_id", wire.read(F.col("payload")).alias("p")).select("tensor_id", F.col("p.header.n_groups").alias("n_groups"), (F.lit(128.0) / F.length("p.body")).alias("ratio"))
    return payload.read(made).join(heads, "tensor_id")


@query("payload_damage", "SELECT fault, CAST(1 AS BIGINT) AS payloads, CAST(CASE WHEN fault = 'none' THEN 0 ELSE 1 END AS BIGINT) AS rejected FROM (VALUES ('none'), ('bit_flip'), ('truncated')) t(fault)")
def payload_damage(spark, sf_dir):
    return payload.detected(payload.write(codec.encode(matrix(spark, sf_dir), codec.CodecConfig(EPS), 64), 64))


@query(
    "payload_nonfinite",
    f"""WITH {ELEMENTS}, x AS (SELECT pos, pos % 1000 = 0 AS bad, pos // 256 AS g FROM el), n AS (SELECT g, bool_or(bad) AS raw FROM x GROUP BY g)
    SELECT (SELECT count(*) FROM n) AS blocks, (SELECT count(*) FROM n WHERE raw) AS nonfinite_blocks, (SELECT count(*) FROM x WHERE bad) AS kept_bits FROM (VALUES (1)) t(one)""",
)
def payload_nonfinite(spark, sf_dir):
    """NaN and both infinities among the values: their blocks are raw, and the values come back bit for bit."""
    bad = F.when(F.col("pos") % 3000 == 0, float("nan")).when(F.col("pos") % 3000 == 1000, float("inf")).otherwise(float("-inf")).cast("float")
    rows = matrix(spark, sf_dir).withColumn("value", F.when(F.col("pos") % 1000 == 0, bad).otherwise(F.col("value")))
    made = codec.encode(rows, codec.CodecConfig(EPS), 64)
    back = payload.read(payload.write(made, 64)).select("pos", F.col("value").alias("got"))
    both = rows.where("pos % 1000 = 0").join(back, "pos").select(payload.same_bits(F.col("value"), F.col("got")).alias("same"))
    kept = both.agg(F.count_if("same").alias("kept_bits"))
    return codec.results(made).select(F.col("total_blocks").alias("blocks"), "nonfinite_blocks").crossJoin(kept)


#: The encoder per label, factor and allocation, step by step as the operator does it.
GRID = f"""{ELEMENTS}, b16 AS (SELECT label, pos, {bf16_sql('v')} AS b FROM el),
sd AS (SELECT label, c, CAST(CAST(c * stddev_samp(CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE) AS eps FROM el, (VALUES {', '.join(f'(CAST({c} AS DOUBLE))' for c in FACTORS)}) t(c) GROUP BY label, c),
x AS (SELECT label, alloc, c, eps, b, CASE alloc WHEN 'blockwise' THEN pos // 256 WHEN 'per_channel' THEN pos % 64 ELSE pos // 64 END AS gid FROM b16 JOIN sd USING (label), (VALUES ('blockwise'), ('per_channel'), ('per_token')) a(alloc)),
g AS (SELECT label, alloc, c, eps, gid, count(*) AS n, min(b) AS gmin, max(b) AS gmax, CAST(max(b) - min(b) AS FLOAT) AS rng FROM x GROUP BY ALL),
p AS (SELECT *, eps - pow(2, floor(log2(greatest(CAST(greatest(abs(gmin), abs(gmax)) AS DOUBLE), 1e-30))) - 8) AS budget FROM g),
w AS (SELECT *, CASE WHEN budget <= 0 THEN 0 WHEN CAST(rng AS DOUBLE) / (2 * budget) + 1 <= 16 THEN 4 WHEN CAST(rng AS DOUBLE) / (2 * budget) + 1 <= 64 THEN 6 WHEN CAST(rng AS DOUBLE) / (2 * budget) + 1 <= 256 THEN 8 ELSE 0 END AS width FROM p),
s AS (SELECT *, CASE WHEN width > 0 AND rng > 0 THEN CAST(CAST(rng AS DOUBLE) / (pow(2, width) - 1) AS FLOAT) ELSE CAST(0 AS FLOAT) END AS scale FROM w),
k AS (SELECT x.label, x.alloc, x.c, x.gid, x.b, s.width, s.gmin, s.scale, CASE WHEN scale > 0 THEN CAST(least(greatest(round_even(CAST(CAST(CAST(x.b - gmin AS FLOAT) AS DOUBLE) / CAST(scale AS DOUBLE) AS FLOAT)::DOUBLE, 0), 0), pow(2, width) - 1) AS INT) ELSE 0 END AS code FROM x JOIN s ON s.label = x.label AND s.alloc = x.alloc AND s.c = x.c AND s.gid = x.gid),
m AS (SELECT label, alloc, c, gid, max(CASE WHEN width = 0 THEN 0 ELSE abs(CAST(b AS DOUBLE) - CAST({bf16_sql('CAST(gmin + CAST(CAST(code AS FLOAT) * scale AS FLOAT) AS FLOAT)')} AS DOUBLE)) END) AS err FROM k GROUP BY ALL),
f AS (SELECT s.*, m.err > s.eps + 1e-6 AS failed, m.err FROM s JOIN m ON m.label = s.label AND m.alloc = s.alloc AND m.c = s.c AND m.gid = s.gid),
z AS (SELECT label, alloc, c, eps, n, CASE WHEN failed OR width = 0 THEN 0 ELSE err END AS err, 9 + CASE WHEN failed OR width = 0 THEN n * 2 ELSE (n * width + 7) // 8 END AS bytes FROM f),
r AS (SELECT label, alloc, c, eps, sum(n) * 2 / sum(bytes) AS ratio, CAST(sum(n) * 2 AS BIGINT) AS original_bytes, CAST(sum(bytes) AS BIGINT) AS compressed_bytes, max(err) AS err FROM z GROUP BY ALL)"""


def _grid(spark, sf_dir):
    return codec.factor_results(matrices(spark, sf_dir), list(FACTORS), channels=64)


@query("codec_relative_grid", f"WITH {GRID} SELECT label AS tensor, alloc AS allocation, c, original_bytes, compressed_bytes, round(ratio, 9) AS ratio, err <= eps + 1e-5 AS within FROM r")
def codec_relative_grid(spark, sf_dir):
    """The allocation study: every tensor, factor and allocation under a bound of the tensor's own."""
    out = _grid(spark, sf_dir).withColumn("within", codec.within_absolute(F.col("max_abs_error"), F.col("eps")))
    return rounded(out.select("tensor", "allocation", "c", "original_bytes", "compressed_bytes", "ratio", "within"), 9, "ratio")


@query("codec_table_a", f"WITH {GRID} SELECT 'codec_' || alloc || '_c' || CAST(c AS VARCHAR) AS method, round(avg(ratio), 9) AS mean_ratio, count(*) AS tensors FROM r GROUP BY alloc, c UNION ALL SELECT 'int8_tensor', round(avg(2 * n / (n + 4)), 9), count(*) FROM (SELECT label, count(*) AS n FROM el GROUP BY label) UNION ALL SELECT 'int8_channel', round(avg(2 * n / (n + 4 * 64)), 9), count(*) FROM (SELECT label, count(*) AS n FROM el GROUP BY label)")
def codec_table_a(spark, sf_dir):
    """Mean ratio of each method over the tensors: both baselines and the grid."""
    rows = matrices(spark, sf_dir)
    base = [codec.int8_baseline(rows, c).select(F.lit(f"int8_{n}").alias("method"), "ratio") for n, c in (("tensor", False), ("channel", True))]
    ours = _grid(spark, sf_dir).select(F.concat(F.lit("codec_"), F.col("allocation"), F.lit("_c"), F.col("c").cast("string")).alias("method"), "ratio")
    out = base[0].unionByName(base[1]).unionByName(ours)
    return rounded(out.groupBy("method").agg(F.avg("ratio").alias("mean_ratio"), F.count("*").alias("tensors")), 9, "mean_ratio")


@query("codec_table_b", f"WITH {GRID} SELECT c, round(avg(ratio), 9) AS mean_ratio, round(max(err / eps), 6) AS worst, count(*) FILTER (WHERE err <= eps + 1e-5) AS within, round(sum(original_bytes) / sum(compressed_bytes), 9) AS cache_ratio FROM r WHERE alloc = 'blockwise' GROUP BY c")
def codec_table_b(spark, sf_dir):
    """Per factor: mean ratio, worst error over the bound, tensors within it, and the ratio of all bytes."""
    own = codec.factor_results(matrices(spark, sf_dir), list(FACTORS), ("blockwise",), 64)
    out = own.groupBy("c").agg(F.avg("ratio").alias("mean_ratio"), F.max(F.col("max_abs_error") / F.col("eps")).alias("worst"), F.count_if(codec.within_absolute(F.col("max_abs_error"), F.col("eps"))).alias("within"))
    cache = codec.round_trip(own, "c").select("c", F.col("ratio").alias("cache_ratio"))
    return rounded(rounded(out.join(cache, "c"), 9, "mean_ratio", "cache_ratio"), 6, "worst")


@query("strategy_bytes", f"WITH {GRID}, t AS (SELECT *, CASE WHEN CAST(label AS INT) % 2 = 0 THEN 'k' ELSE 'v' END AS kind FROM r WHERE alloc = 'blockwise' AND c = 0.03) SELECT strategy, CAST(sum(CASE WHEN strategy = 'uniform' OR strategy = kind || '_only' THEN compressed_bytes ELSE original_bytes END) AS BIGINT) AS bytes, CAST(sum(original_bytes) AS BIGINT) AS raw_bytes FROM t, (VALUES ('uniform'), ('k_only'), ('v_only')) s(strategy) GROUP BY strategy")
def strategy_bytes(spark, sf_dir):
    """Bytes moved by each strategy; tensors of even labels stand for keys, of odd ones for values."""
    own = codec.factor_results(matrices(spark, sf_dir), [0.03], ("blockwise",), 64).withColumn("kind", F.when(F.col("tensor").cast("int") % 2 == 0, "k").otherwise("v"))
    rows = own.withColumn("strategy", F.explode(F.array(*map(F.lit, codec.STRATEGIES))))
    moved = F.when(codec.applies(F.col("strategy"), F.col("kind")), F.col("compressed_bytes")).otherwise(F.col("original_bytes"))
    return rows.groupBy("strategy").agg(F.sum(moved).alias("bytes"), F.sum("original_bytes").alias("raw_bytes"))

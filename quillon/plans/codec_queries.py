"""Queries over the codec and tensor statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, codec, stats, tensors
from .base import ELEMENTS, bf16_sql, matrices, matrix, query, rounded, table

EPS = 0.05


def _bounds(allocation: str):
    def run(spark, sf_dir):
        cfg = codec.CodecConfig(EPS, allocation, dtype="fp32")
        return codec.group_bounds(codec.with_groups(matrix(spark, sf_dir), cfg, 64)).select("group_id", "n", "gmin", "gmax")

    return run


for _name, _sql in (("blockwise", "pos // 256"), ("per_channel", "pos % 64"), ("per_token", "pos // 64")):
    query(f"group_bounds_{_name}", f"WITH {ELEMENTS} SELECT {_sql} AS group_id, count(*) AS n, min(v) AS gmin, max(v) AS gmax FROM el GROUP BY 1")(_bounds(_name))


def codec_sql(eps: float, group: str, width: int | None, select: str) -> str:
    """The encoder over the bf16 matrix, step by step as the operator does it."""
    half = "pow(2, floor(log2(greatest(CAST(greatest(abs(gmin), abs(gmax)) AS DOUBLE), 1e-30))) - 8)"
    if width is None:
        choice = "CASE WHEN budget <= 0 THEN 0 " + " ".join(f"WHEN CAST(rng AS DOUBLE) / (2 * budget) + 1 <= {2**w} THEN {w}" for w in codec.WIDTHS) + " ELSE 0 END"
    else:
        choice = f"CASE WHEN budget > 0 AND CAST(rng AS DOUBLE) / {2**width - 1} / 2 <= budget THEN {width} ELSE 0 END"
    code = "CAST(least(greatest(round_even(CAST(CAST(CAST(b - gmin AS FLOAT) AS DOUBLE) / CAST(scale AS DOUBLE) AS FLOAT)::DOUBLE, 0), 0), pow(2, width) - 1) AS INT)"
    back = bf16_sql("CAST(gmin + CAST(CAST(code AS FLOAT) * scale AS FLOAT) AS FLOAT)")
    return f"""WITH {ELEMENTS},
    b16 AS (SELECT label, pos, channel, row_id, {bf16_sql('v')} AS b FROM el),
    g AS (SELECT {group} AS group_id, count(*) AS n, min(b) AS gmin, max(b) AS gmax, CAST(max(b) - min(b) AS FLOAT) AS rng FROM b16 GROUP BY 1),
    p AS (SELECT *, {eps} - {half} AS budget FROM g),
    w AS (SELECT *, {choice} AS width FROM p),
    s AS (SELECT *, CASE WHEN width > 0 AND rng > 0 THEN CAST(CAST(rng AS DOUBLE) / (pow(2, width) - 1) AS FLOAT) ELSE CAST(0 AS FLOAT) END AS scale FROM w),
    c AS (SELECT b16.*, s.group_id, s.gmin, s.scale, s.width, CASE WHEN scale > 0 THEN {code} ELSE 0 END AS code FROM b16 JOIN s ON s.group_id = {group}),
    r AS (SELECT *, CASE WHEN width = 0 THEN b ELSE {back} END AS restored FROM c),
    m AS (SELECT group_id, max(abs(CAST(b AS DOUBLE) - CAST(restored AS DOUBLE))) AS err FROM r GROUP BY 1),
    f AS (SELECT s.group_id, s.n, CASE WHEN m.err > {eps} + 1e-6 THEN 0 ELSE s.width END AS width, CASE WHEN m.err > {eps} + 1e-6 OR s.width = 0 THEN 0 ELSE m.err END AS max_err FROM s JOIN m USING (group_id)),
    z AS (SELECT *, 9 + CASE WHEN width = 0 THEN n * 2 ELSE (n * width + 7) // 8 END AS bytes FROM f)
    {select}"""


RESULT_SQL = """SELECT CAST(sum(n) * 2 AS BIGINT) AS original_bytes, CAST(sum(bytes) AS BIGINT) AS compressed_bytes,
    CASE WHEN count(DISTINCT nullif(width, 0)) = 1 THEN max(nullif(width, 0)) ELSE -1 END AS bit_width,
    count(*) AS total_blocks, count(*) FILTER (WHERE width = 0) AS raw_blocks, round(max(max_err), 9) AS max_abs_error,
    round(100.0 * avg(CASE WHEN width = 0 THEN 1 ELSE 0 END), 6) AS raw_pct, round(sum(n) * 2 / sum(bytes), 9) AS ratio FROM z"""


def _result(cfg: codec.CodecConfig):
    def run(spark, sf_dir):
        out = codec.results(codec.encode(matrix(spark, sf_dir), cfg, 64))
        out = out.withColumn("raw_blocks", F.round(F.col("raw_pct") / 100 * F.col("total_blocks")).cast("bigint"))
        return rounded(out.select("original_bytes", "compressed_bytes", "bit_width", "total_blocks", "raw_blocks", "max_abs_error", "raw_pct", "ratio"), 9, "max_abs_error", "raw_pct", "ratio").withColumn("raw_pct", F.round("raw_pct", 6))

    return run


query("codec_size_ratio", codec_sql(EPS, "pos // 256", None, RESULT_SQL))(_result(codec.CodecConfig(EPS)))
for _w in codec.WIDTHS:
    query(f"codec_fixed_w{_w}", codec_sql(EPS, "pos // 256", _w, RESULT_SQL))(_result(codec.CodecConfig(EPS, bit_width=_w)))
for _name, _sql in (("per_channel", "pos % 64"), ("per_token", "pos // 64")):
    query(f"codec_{_name}", codec_sql(0.01, _sql, None, RESULT_SQL))(_result(codec.CodecConfig(0.01, _name)))


@query("codec_widths_adaptive", codec_sql(0.004, "pos // 256", None, "SELECT group_id, n, width, bytes, round(max_err, 9) AS max_err FROM z"))
def codec_widths(spark, sf_dir):
    out = codec.encode(matrix(spark, sf_dir), codec.CodecConfig(0.004), 64).groups
    return rounded(out.select("group_id", "n", "width", "bytes", "max_err"), 9, "max_err")


@query("codec_decode", codec_sql(EPS, "pos // 256", None, "SELECT r.pos, CASE WHEN z.width = 0 THEN r.b ELSE r.restored END AS value FROM r JOIN z USING (group_id)"))
def codec_decode(spark, sf_dir):
    return codec.decode(codec.encode(matrix(spark, sf_dir), codec.CodecConfig(EPS), 64)).select("pos", "value")


def _int8(keys: str, scales: str) -> str:
    value = f"CAST(least(greatest(round_even(CAST(CAST(b AS DOUBLE) / CAST(scale AS DOUBLE) AS FLOAT)::DOUBLE, 0), -127), 127) AS FLOAT)"
    return f"""WITH {ELEMENTS}, b16 AS (SELECT label, channel, {bf16_sql('v')} AS b FROM el),
    t AS (SELECT {keys}, greatest(CAST(CAST(max(abs(b)) AS DOUBLE) / 127 AS FLOAT), CAST(1e-30 AS FLOAT)) AS scale FROM b16 GROUP BY {keys}),
    q AS (SELECT label, channel, b, {bf16_sql(f'CAST({value} * scale AS FLOAT)')} AS y FROM b16 JOIN t USING ({keys}))
    SELECT label AS tensor_id, count(*) AS n, round(2 * count(*) / (count(*) + 4 * {scales}), 9) AS ratio, round(max(abs(CAST(b AS DOUBLE) - CAST(y AS DOUBLE))), 9) AS max_abs_error FROM q GROUP BY label"""


for _name, _keys, _scales in (("tensor", "label", "1"), ("channel", "label, channel", "count(DISTINCT channel)")):
    query(f"int8_baseline_{_name}", _int8(_keys, _scales))(lambda spark, sf_dir, c=_name == "channel": rounded(codec.int8_baseline(matrices(spark, sf_dir), c), 9, "ratio", "max_abs_error"))


_INT8_ERROR = f"""(SELECT max(abs(CAST(b AS DOUBLE) - CAST(y AS DOUBLE))) FROM (SELECT b, {bf16_sql("CAST(CAST(least(greatest(round_even(CAST(CAST(b AS DOUBLE) / CAST(scale AS DOUBLE) AS FLOAT)::DOUBLE, 0), -127), 127) AS FLOAT) * scale AS FLOAT)")} AS y
    FROM b16, (SELECT greatest(CAST(CAST(max(abs(b)) AS DOUBLE) / 127 AS FLOAT), CAST(1e-30 AS FLOAT)) AS scale FROM b16) t))"""


@query("matched_error", codec_sql(_INT8_ERROR, "pos // 256", None, f"SELECT 'int8' AS method, round(2 * count(*) / (count(*) + 4), 6) AS ratio, {_INT8_ERROR} AS max_abs_error FROM b16 UNION ALL SELECT 'codec', round(sum(n) * 2 / sum(bytes), 6), max(max_err) FROM z"))
def matched_error(spark, sf_dir):
    """The codec at the int8 baseline's error: one row for the baseline and one for the codec."""
    rows = matrix(spark, sf_dir)
    base = codec.int8_baseline(rows, False)
    eps = base.first()["max_abs_error"]
    ours = codec.results(codec.encode(rows, codec.CodecConfig(eps), 64))
    a = base.select(F.lit("int8").alias("method"), F.round("ratio", 6).alias("ratio"), "max_abs_error")
    return a.unionByName(ours.select(F.lit("codec").alias("method"), F.round("ratio", 6).alias("ratio"), "max_abs_error"))


_y = "CAST(round_even(CAST(v AS DOUBLE) / 0.02, 0) * 0.02 AS FLOAT)"


@query(
    "three_way_error",
    f"""WITH {ELEMENTS}, x AS (SELECT label, v AS x, {_y} AS y, {bf16_sql(_y)} AS z FROM el),
    e AS (SELECT label, max(abs(CAST(x AS DOUBLE) - y)) AS e32, max(abs(CAST(x AS DOUBLE) - z)) AS ebf, max(abs(CAST(y AS DOUBLE) - z)) AS r FROM x GROUP BY label)
    SELECT label, round(e32, 9) AS e32, round(ebf, 9) AS ebf, round(r, 9) AS r, e32 <= 0.01 + 1e-6 AS within_eps, ebf <= 0.01 + 1e-6 + r AS within_eps_plus_round, e32 <= 0.01 * 1.001 AS within_relative FROM e""",
)
def three_way_error(spark, sf_dir):
    from ..functions.numerics import round_to

    y = (F.rint(F.col("value").cast("double") / 0.02) * 0.02).cast("float")
    rows = matrices(spark, sf_dir).select(F.col("tensor_id").alias("label"), F.col("value").alias("x"), y.alias("y")).withColumn("z", round_to("y", "bf16"))
    return rounded(codec.three_way_errors(rows, F.lit(0.01), ["label"]).drop("finite"), 9, "e32", "ebf", "r")


_PACK = {4: "string_agg(printf('%X', code), '' ORDER BY channel)", 8: "string_agg(printf('%02X', code), '' ORDER BY channel)"}


def _packed(width: int):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v, i: F.pmod(F.col("vec_id") * 7 + i * 3, F.lit(2**width)).cast("int")).alias("codes"))
        rows = rows.withColumn("body", codec.pack_codes(F.col("codes"), width))
        rows = rows.withColumn("back", codec.unpack_codes(F.col("body"), width, F.size("codes")))
        return rows.select("vec_id", F.hex("body").alias("packed"), F.length("body").alias("n_bytes"), (F.col("back") == F.col("codes")).alias("round_trip"))

    return run


for _w in codec.WIDTHS:
    _codes = f"SELECT vec_id, c AS channel, (vec_id * 7 + c * 3) % {2**_w} AS code FROM (SELECT vec_id, unnest(range(64)) AS c FROM embeddings)"
    if _w == 6:
        _sql = f"WITH k AS ({_codes}), q AS (SELECT vec_id, channel // 4 AS g, sum(code * CAST(pow(64, 3 - channel % 4) AS BIGINT)) AS x FROM k GROUP BY ALL) SELECT vec_id, string_agg(printf('%06X', CAST(x AS BIGINT)), '' ORDER BY g) AS packed, 48 AS n_bytes, true AS round_trip FROM q GROUP BY vec_id"
    else:
        _sql = f"WITH k AS ({_codes}) SELECT vec_id, {_PACK[_w]} AS packed, {64 * _w // 8} AS n_bytes, true AS round_trip FROM k GROUP BY vec_id"
    query(f"pack_codes_w{_w}", _sql)(_packed(_w))


@query("relative_eps", f"WITH {ELEMENTS}, s AS (SELECT label, stddev_samp(CAST(v AS DOUBLE)) AS std FROM el GROUP BY label) SELECT label AS tensor_id, c, round(c * std, 6) AS eps FROM s, (VALUES (0.01), (0.03), (0.1)) t(c)")
def relative_eps(spark, sf_dir):
    rows = matrices(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    out = codec.relative_eps(rows, [0.01, 0.03, 0.1])
    return out.select("tensor_id", F.col("c").cast("decimal(3,2)").alias("c"), F.round(F.col("eps").cast("double"), 6).alias("eps"))


@query("bypass_reasons", "SELECT vec_id, CASE WHEN label = 0 THEN 'dtype' WHEN label % 3 = 1 THEN 'not_contiguous' WHEN vec_id * 64 < 256 THEN 'tensor_too_small' END AS reason FROM embeddings")
def bypass_reasons(spark, sf_dir):
    dtype = F.when(F.col("label") == 0, "int8").otherwise("bf16")
    return table(spark, sf_dir, "embeddings").select("vec_id", codec.bypass_reason(dtype, F.col("label") % 3 != 1, F.col("vec_id") * 64, 256).alias("reason"))


@query(
    "tensor_stats_by_label",
    f"""WITH {ELEMENTS}, d AS (SELECT label, CAST(v AS DOUBLE) AS v, CAST(v AS DOUBLE) - lag(CAST(v AS DOUBLE)) OVER (PARTITION BY label, row_id ORDER BY channel) AS diff FROM el),
    b AS (SELECT label, count(*) AS n, stddev_samp(v) AS std, avg(v) AS mean, max(v) - min(v) AS range, max(abs(v)) AS absmax, stddev_samp(diff) AS adjdiff_std FROM d GROUP BY label),
    s AS (SELECT d.label, avg(CASE WHEN abs(v) > 4 * std THEN 1 ELSE 0 END) AS outlier_rate, avg(CASE WHEN abs(v) < 0.01 * std THEN 1 ELSE 0 END) AS near_zero_frac FROM d JOIN b USING (label) GROUP BY d.label)
    SELECT label AS tensor_id, n, round(std, 6) AS std, round(mean, 6) + 0.0 AS mean, round(range, 6) AS range, round(absmax, 6) AS absmax, round(adjdiff_std, 6) AS adjdiff_std, CAST(0 AS BIGINT) AS nonfinite,
    round(outlier_rate, 6) AS outlier_rate, round(near_zero_frac, 6) AS near_zero_frac, round(adjdiff_std / std, 6) AS adjdiff_over_std FROM b JOIN s USING (label)""",
)
def tensor_stats_by_label(spark, sf_dir):
    return rounded(stats.tensor_stats(matrices(spark, sf_dir)), 6, "std", "mean", "range", "absmax", "adjdiff_std", "outlier_rate", "near_zero_frac", "adjdiff_over_std")


@query(
    "axis_predictability",
    f"""WITH {ELEMENTS}, d AS (SELECT label, CAST(v AS DOUBLE) AS v, CAST(v AS DOUBLE) - lag(CAST(v AS DOUBLE)) OVER (PARTITION BY label, row_id ORDER BY channel) AS dc,
    CAST(v AS DOUBLE) - lag(CAST(v AS DOUBLE)) OVER (PARTITION BY label, channel ORDER BY row_id) AS dt FROM el)
    SELECT label AS tensor_id, round(stddev_pop(dc) / stddev_pop(v), 6) AS channel, round(stddev_pop(dt) / stddev_pop(v), 6) AS token FROM d GROUP BY label""",
)
def axis_predictability(spark, sf_dir):
    rows = matrices(spark, sf_dir).withColumnRenamed("channel", "ch")
    return rounded(stats.axis_predictability(rows, {"channel": (["row_id"], "ch"), "token": (["ch"], "row_id")}), 6, "channel", "token")


@query("scale_spread_channels", f"WITH {ELEMENTS}, s AS (SELECT label, channel, max(abs(CAST(v AS DOUBLE))) AS x FROM el GROUP BY ALL) SELECT label AS tensor_id, round(max(x) / median(x), 6) AS max_over_median, round(stddev_pop(x) / avg(x), 6) AS cv FROM s GROUP BY label")
def scale_spread_channels(spark, sf_dir):
    return rounded(stats.scale_spread(matrices(spark, sf_dir), "channel"), 6, "max_over_median", "cv")


@query("layout_positions", f"WITH {ELEMENTS}, f AS (SELECT row_id % 5 AS h, row_id // 5 AS s, channel AS d, v, (SELECT max(vec_id) // 5 + 1 FROM embeddings) AS t FROM el) SELECT layout, sum(CASE layout WHEN 'HSD' THEN (h * t + s) * 64 + d WHEN 'TD' THEN (s * 5 + h) * 64 + d ELSE (h * 64 + d) * t + s END * (d + 1))::BIGINT AS weighted, count(*) AS n FROM f, (VALUES ('HSD'), ('TD'), ('HDS')) l(layout) GROUP BY layout")
def layout_positions(spark, sf_dir):
    rows = matrix(spark, sf_dir).select(F.pmod("row_id", F.lit(5)).alias("h"), F.floor(F.col("row_id") / 5).alias("s"), F.col("channel").cast("bigint").alias("d"), "value")
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] // 5 + 1
    return tensors.all_layouts(rows, 5, n, 64).groupBy("layout").agg(F.sum(F.col("pos") * (F.col("d") + 1)).alias("weighted"), F.count("*").alias("n"))


@query("value_correlation", "SELECT label, round(corr(CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)), 6) AS r FROM embeddings GROUP BY label")
def value_correlation(spark, sf_dir):
    a, b = (F.get("embedding", F.lit(k)).cast("double") for k in (0, 1))
    return rounded(table(spark, sf_dir, "embeddings").groupBy("label").agg(F.corr(a, b).alias("r")), 6, "r")


@query("fault_detection", "SELECT fault, n AS tensors, CASE WHEN fault = 'none' THEN 0 ELSE n END AS rejected, true AS detected FROM (SELECT count(DISTINCT label) AS n FROM embeddings), (VALUES ('none'), ('nan'), ('pos_inf'), ('neg_inf'), ('over_bound'), ('bit_flip'), ('truncated')) t(fault)")
def fault_detection(spark, sf_dir):
    rows = matrices(spark, sf_dir)
    first = rows.groupBy("tensor_id").agg(F.min("pos").alias("p0"))
    rows = rows.join(first, "tensor_id").select("tensor_id", (F.col("pos") - F.col("p0")).alias("pos"), F.col("value").cast("double").alias("value"), F.col("value").cast("double").alias("delivered"))
    return checks.fault_suite(rows, 0.05)


@query("exact_and_zero", f"WITH {ELEMENTS} SELECT label, round(avg(CASE WHEN v = CAST({bf16_sql('v')} AS FLOAT) THEN 1 ELSE 0 END), 9) AS exact, round(avg(CASE WHEN v = 0 THEN 1 ELSE 0 END), 9) AS zero FROM el GROUP BY label")
def exact_and_zero(spark, sf_dir):
    from ..functions.numerics import round_to

    rows = matrices(spark, sf_dir).select(F.col("tensor_id").alias("label"), F.col("value").alias("a"), round_to("value", "bf16").alias("b"))
    return rounded(checks.exact_and_zero(rows, ["label"], "a", "b"), 9, "exact", "zero")

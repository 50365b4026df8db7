"""Queries over study tables: means, feeds of figures, schedules, orders, reports and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec, quality, resample, stats, tables, trials
from ..sources import tensorfiles
from .base import ELEMENTS, TRIALS, matrices, query, rounded, table
from .base import trials as trial_rows
from .payload_queries import GRID
from .study_queries import _arms, _baseline, _regression


@query("mean_by_key", f"WITH {TRIALS} SELECT path, segment, round(avg(compressed_s / raw_s), 9) AS mean, count(*) AS n FROM trials WHERE cache IN ('A', 'N') GROUP BY ALL")
def mean_by_key(spark, sf_dir):
    rows = trial_rows(spark, sf_dir).withColumn("r", F.col("compressed_s") / F.col("raw_s"))
    return rounded(tables.mean_by(rows, ["path", "segment"], "r", F.col("cache").isin("A", "N")), 9, "mean")


@query("tuning_held_out", "SELECT CASE WHEN split_part(o_orderpriority, '-', 1) IN ('1', '2') THEN 'tuning' ELSE 'held_out' END AS split, round(avg(o_totalprice), 6) AS mean, count(*) AS n FROM orders GROUP BY 1")
def tuning_held_out(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("split", tables.prefix_split(F.col("o_orderpriority"), ["1", "2"]))
    return rounded(tables.mean_by(rows, ["split"], "o_totalprice"), 6, "mean")


@query("ratio_of_medians", f"WITH {TRIALS}, m AS (SELECT cache, path, median(raw_s) AS a, median(compressed_s) AS b, avg(segment) AS p FROM trials GROUP BY ALL) SELECT cache, path, round(a, 6) AS raw_median_s, round(b, 6) AS compressed_median_s, round(p, 9) AS predicted, round(b / a, 9) AS ratio, round(a - b, 6) + 0.0 AS net_s, round(b / a / p, 9) AS measured_over_predicted FROM m")
def ratio_of_medians(spark, sf_dir):
    out = tables.ratio_of_medians(trial_rows(spark, sf_dir), ["cache", "path"], "segment")
    return rounded(rounded(out, 6, "raw_median_s", "compressed_median_s", "net_s"), 9, "predicted", "ratio", "measured_over_predicted")


@query("median_by_kind", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'k' ELSE 'v' END AS kind, o_orderstatus AS key, round(median(o_totalprice), 6) AS mid FROM orders GROUP BY ALL")
def median_by_kind(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "k").otherwise("v").alias("kind"), F.col("o_orderstatus").alias("key"), "o_totalprice")
    return rounded(tables.median_by(rows, ["kind", "key"], "o_totalprice"), 6, "mid")


@query(
    "breakdown_net",
    f"WITH {TRIALS}, m AS (SELECT cache, path, median(compressed_s) AS x, CAST(max(pair) AS DOUBLE) AS nbytes, median(raw_s) AS r FROM trials GROUP BY ALL) SELECT cache, path, round(x, 6) AS median_s, round(x / sum(x) OVER (PARTITION BY cache), 9) AS share, round(nbytes / 1e9 / x, 12) AS gbps, round(max(r) OVER (PARTITION BY cache) - sum(x) OVER (PARTITION BY cache), 6) AS net_s FROM m",
)
def breakdown_net(spark, sf_dir):
    out = tables.breakdown(trial_rows(spark, sf_dir), ["cache"], "path", "compressed_s", "pair", "raw_s")
    return rounded(rounded(rounded(out, 6, "median_s", "net_s"), 9, "share"), 12, "gbps")


@query("slot_schedule", "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS number FROM orders) SELECT o_custkey, o_orderkey, number % 4 AS slot, number >= 4 AS reused, number % 3 = 2 AS third FROM n")
def slot_schedule(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return tables.slots(rows, ["o_custkey"], "o_orderkey", 4).select("o_custkey", "o_orderkey", F.col("slot").cast("bigint").alias("slot"), "reused", "third")


@query("integer_key_order", "SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT), p_partkey) AS place FROM part")
def integer_key_order(spark, sf_dir):
    """Parts ordered by the integer in their brand, not by its text."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_type").orderBy(tables.integer_in(F.col("p_brand")), "p_partkey")
    return table(spark, sf_dir, "part").select("p_type", "p_partkey", F.row_number().over(w).cast("bigint").alias("place"))


@query("first_predicting", "SELECT path, label, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, label) AS place FROM (SELECT l_linestatus AS path, l_returnflag AS label, avg(l_discount) AS score FROM lineitem GROUP BY ALL) WHERE label <> 'N') WHERE place = 1")
def first_predicting(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("path"), F.col("l_returnflag").alias("label")).agg(F.avg("l_discount").alias("score"))
    return rounded(tables.first_other(rows, ["path"], "score", "label", "N"), 9, "score")


@query("cell_order", "SELECT path, c, mode, row_number() OVER (PARTITION BY path ORDER BY md5(concat_ws('|', '7', path, CAST(c AS VARCHAR), mode)), c, mode) - 1 AS turn FROM (SELECT DISTINCT o_orderstatus AS path FROM orders), (VALUES (1), (3), (10)) a(c), (VALUES ('fixed'), ('plain')) b(mode)")
def cell_order(spark, sf_dir):
    """The cells of each process in a drawn order."""
    axes = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(m).alias("mode")) for c in (1, 3, 10) for m in ("fixed", "plain")])).alias("cell")
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("path")).distinct().select("path", axes).select("path", "cell.*")
    return tables.shuffled_cells(cells, ["path"], ["c", "mode"], 7).withColumn("turn", F.col("turn").cast("bigint"))


@query("forced_order", "WITH e AS (SELECT o_orderstatus AS path, max(o_totalprice) AS a, min(o_totalprice) AS b FROM orders GROUP BY 1) SELECT path, 0 AS turn, a AS o_totalprice FROM e UNION ALL SELECT path, 1, b FROM e UNION ALL SELECT path, 2, a FROM e")
def forced_order(spark, sf_dir):
    return tables.large_small_large(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "path"), ["path"], "o_totalprice")


@query("early_middle_late", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS spot, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE spot IN (0, n // 2, n - 1)")
def early_middle_late(spark, sf_dir):
    return tables.early_middle_late(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id")


@query("view_grid", "SELECT CAST(label AS VARCHAR) AS tensor, view, c, tag FROM (SELECT DISTINCT label FROM embeddings), (VALUES ('HSD'), ('TD'), ('HDS')) v(view), (VALUES (0.01::DOUBLE), (0.1::DOUBLE)) f(c), (VALUES ('w4'), ('w6'), ('w8')) t(tag)")
def view_grid(spark, sf_dir):
    tensors_ = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("tensor")).distinct()
    return tables.views(tensors_, ["HSD", "TD", "HDS"], [0.01, 0.1], spark.createDataFrame([("w4",), ("w6",), ("w8",)], "tag string"))


@query("kind_pairs", "SELECT label // 2 AS layer, round(max(CASE WHEN label % 2 = 0 THEN s END), 6) AS k, round(max(CASE WHEN label % 2 = 1 THEN s END), 6) AS v FROM (SELECT label, CAST(count(*) AS DOUBLE) AS s FROM embeddings GROUP BY label) GROUP BY 1 HAVING count(DISTINCT label % 2) = 2")
def kind_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").cast("double").alias("s")).select(F.floor(F.col("label") / 2).cast("int").alias("layer"), F.when(F.col("label") % 2 == 0, "k").otherwise("v").alias("kind"), "s")
    return tables.zip_kinds(rows, ["layer"], "kind", "s")


@query("stats_with_best", f"WITH {GRID}, best AS (SELECT label, max(ratio) AS best FROM r GROUP BY label), sd1 AS (SELECT label, stddev_samp(CAST(v AS DOUBLE)) AS std, max(abs(CAST(v AS DOUBLE))) AS absmax FROM el GROUP BY label) SELECT count(*) AS tensors, round(corr(best, absmax / std), 6) AS r FROM best JOIN sd1 USING (label)")
def stats_with_best(spark, sf_dir):
    """How the spread of a tensor goes with the best ratio over the grid."""
    rows = matrices(spark, sf_dir)
    best = codec.factor_results(rows, [0.01, 0.03, 0.1], channels=64).groupBy("tensor").agg(F.max("ratio").alias("best"))
    both = best.join(stats.tensor_stats(rows).withColumnRenamed("tensor_id", "tensor"), "tensor")
    return rounded(both.agg(F.count("*").alias("tensors"), F.corr("best", F.col("absmax") / F.col("std")).alias("r")), 6, "r")


@query("best_per_view", f"WITH {GRID} SELECT c, round(avg(best), 9) AS oracle_mean, round(avg(fixed), 9) AS fixed_mean, round(avg(best / fixed), 9) AS mean_gain FROM (SELECT label, c, max(ratio) AS best, max(CASE WHEN alloc = 'blockwise' THEN ratio END) AS fixed FROM r GROUP BY ALL) GROUP BY c")
def best_per_view(spark, sf_dir):
    """Per factor: the mean of each tensor's best allocation next to a fixed one."""
    own = codec.factor_results(matrices(spark, sf_dir), [0.01, 0.03, 0.1], channels=64)
    cells = own.groupBy("tensor", "c").agg(F.max("ratio").alias("best"), F.max(F.when(F.col("allocation") == "blockwise", F.col("ratio"))).alias("fixed"))
    out = cells.groupBy("c").agg(F.avg("best").alias("oracle_mean"), F.avg("fixed").alias("fixed_mean"), F.avg(F.col("best") / F.col("fixed")).alias("mean_gain"))
    return rounded(out, 9, "oracle_mean", "fixed_mean", "mean_gain")


@query("speedup_table", "WITH m AS (SELECT o_orderpriority AS config, median(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS raw, median(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS compressed FROM orders GROUP BY 1) SELECT config, round(raw, 6) AS raw, round(compressed, 6) AS compressed, round(raw / compressed, 9) AS speedup FROM m")
def speedup_table(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("config"), F.when(F.col("o_orderkey") % 2 == 0, "raw").otherwise("compressed").alias("arm"), "o_totalprice")
    return rounded(rounded(tables.speedups(rows, ["config"], "arm", "o_totalprice"), 6, "raw", "compressed"), 9, "speedup")


@query("pipeline_study", "WITH m AS (SELECT o_orderstatus AS transport, o_orderpriority AS arm, median(o_totalprice) AS x FROM orders GROUP BY ALL) SELECT a.transport, a.arm, round(a.x, 6) AS median_s, round(a.x / b.x, 9) AS ratio, a.x / b.x > 0.85 AND a.x / b.x < 1.15 AS control FROM m a JOIN m b ON b.transport = a.transport AND b.arm = '1-URGENT'")
def pipeline_study(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("transport"), F.col("o_orderpriority").alias("arm"), "o_totalprice")
    out = tables.against_serial(rows, ["transport"], "arm", "o_totalprice", "1-URGENT").drop("serial_s")
    return rounded(rounded(out, 6, "median_s"), 9, "ratio")


@query("cache_constants", f"WITH {GRID} SELECT alloc AS cache, count(*) AS tensors, CAST(sum(original_bytes) AS BIGINT) AS raw_bytes, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes, max(original_bytes // 2) AS max_numel, max(CAST(eps AS FLOAT)) AS eps_max FROM r WHERE c = 0.1 GROUP BY alloc")
def cache_constants(spark, sf_dir):
    own = codec.factor_results(matrices(spark, sf_dir), [0.1], channels=64)
    rows = own.withColumn("numel", F.call_function("div", F.col("original_bytes"), F.lit(2).cast("bigint"))).withColumnRenamed("allocation", "cache")
    return tables.cache_constants(rows, "cache")


_CHECKS = "ch AS (SELECT l_linestatus AS path, l_returnflag AS arm, l_tax = 0 AS exact, l_tax AS err, l_discount AS eps, l_quantity AS magnitude FROM lineitem)"


def _checks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("path"), F.col("l_returnflag").alias("arm"), (F.col("l_tax") == 0).alias("exact"), F.col("l_tax").alias("err"), F.col("l_discount").alias("eps"), F.col("l_quantity").alias("magnitude"))


@query("moved_check", f"WITH {_CHECKS} SELECT arm, count(*) AS tensors, count(*) FILTER (WHERE NOT exact) AS mismatched, max(err) AS worst, max(eps) AS eps_max, max(err) <= max(eps) + 1e-6 + pow(2, floor(log2(max(magnitude))) - 8) AS within FROM ch GROUP BY arm")
def moved_check(spark, sf_dir):
    return tables.moved_check(_checks(spark, sf_dir), "arm")


@query("verify_summary", f"WITH {_CHECKS} SELECT path, arm, count(*) AS checks, bool_and(err <= eps + 1e-6) AS all_ok, bool_or(err <= eps + 1e-6) AS any_ok, count(*) FILTER (WHERE NOT err <= eps + 1e-6) AS failing, count(*) FILTER (WHERE exact) AS byte_exact, round(max(err / nullif(eps, 0)), 9) AS worst_over_eps FROM ch GROUP BY ALL")
def verify_summary(spark, sf_dir):
    return rounded(tables.verified(_checks(spark, sf_dir), ["path", "arm"]), 9, "worst_over_eps")


@query("damage_predicate", f"WITH {_CHECKS} SELECT path, arm, count(*) FILTER (WHERE err / nullif(eps, 0) > 1.001 OR eps = 0) AS damaged FROM ch GROUP BY ALL")
def damage_predicate(spark, sf_dir):
    rows = _checks(spark, sf_dir).withColumn("bound", F.nullif("eps", F.lit(0.0)))
    return rows.groupBy("path", "arm").agg(F.count_if(codec.damaged(F.col("err"), F.col("bound"), F.lit(True))).alias("damaged"))


@query("alignment_report", "WITH w AS (SELECT user_id AS doc, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS low, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS high FROM events GROUP BY 1) SELECT round(avg(low) / avg(high), 9) AS gap_ratio, bool_or(doc % 5 = 1) AS shift_helps FROM w")
def alignment_report(spark, sf_dir):
    """Mean gaps of two types next to each other, and whether any shift was better than none."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc"), F.when(F.col("event_id") % 2 == 0, "bf16").otherwise("fp32").alias("dtype")).agg(F.avg("value").alias("mean_gap"))
    return rounded(quality.dtype_verdict(rows.withColumn("best_shift", (F.col("doc") % 5 == 1).cast("int"))), 9, "gap_ratio")


@query("preflight", "WITH g AS (SELECT max(abs(value - value)) AS a, max(abs(value - value * 0.9)) AS b FROM events) SELECT a AS replacement_gap, round(b, 9) AS cached_gap, a <= 1e-6 AS ok, b > 1e-3 AS investigate FROM g")
def preflight(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("value").alias("nll"))
    return rounded(quality.preflight(rows.withColumn("other", F.col("nll")), rows.withColumn("other", F.col("nll") * 0.9)), 9, "cached_gap")


@query("protocol_gate", "SELECT CAST(s AS INT) AS stage, ok, s <= 2 AS runs FROM (VALUES (0, true), (1, true), (2, false), (3, true)) t(s, ok)")
def protocol_gate(spark, sf_dir):
    return tables.stage_gate(spark.createDataFrame([(0, True), (1, True), (2, False), (3, True)], "stage int, ok boolean"), "stage", "ok")


@query("protocol_document", """SELECT '{"draws":"5000","factors":"0.01,0.03,0.1","seed":"1"}' AS document, substr(sha256('{"draws":"5000","factors":"0.01,0.03,0.1","seed":"1"}'), 1, 16) AS name""")
def protocol_document(spark, sf_dir):
    return tables.protocol(spark, {"seed": 1, "draws": 5000, "factors": "0.01,0.03,0.1"}).drop("frozen_at")


@query("token_ids_hash", "SELECT o_custkey, substr(sha1(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)), 1, 16) AS ids_sha1 FROM orders GROUP BY 1")
def token_ids_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return rows.select("o_custkey", tables.ids_hash(F.col("ids")).alias("ids_sha1"))


@query("write_size_sweep", "WITH m AS (SELECT CAST(l_linenumber AS BIGINT) * 1000000 AS size, median(l_extendedprice) AS x, count(*) AS reps FROM lineitem GROUP BY 1) SELECT size, round(x, 6) AS median_s, reps, round(size / 1e9 / x, 15) AS gbps, round(size / x / max(size / x) OVER (), 9) AS of_best FROM m")
def write_size_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber").cast("bigint") * 1_000_000).alias("size"), F.col("l_extendedprice").alias("seconds"))
    return rounded(rounded(rounded(tables.write_sizes(rows, "size", "seconds"), 6, "median_s"), 15, "gbps"), 9, "of_best")


@query("volume_control", "WITH m AS (SELECT CAST(l_linenumber AS BIGINT) AS volume, median(l_extendedprice) AS x FROM lineitem GROUP BY 1) SELECT volume, round(x, 6) AS median_s, round(x / (SELECT arg_max(x, volume) FROM m), 9) AS time_share, round(volume / (SELECT max(volume) FROM m), 9) AS byte_share FROM m")
def volume_control(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("volume"), F.col("l_extendedprice").alias("seconds"))
    return rounded(rounded(tables.volume_control(rows, "volume", "seconds"), 6, "median_s"), 9, "time_share", "byte_share")


@query("tensor_scan", f"SELECT 'embeddings.parquet' AS file, CAST(0 AS BIGINT) AS ordinal, row_id, count(*) AS channels, round(sum(CAST(v AS DOUBLE)), 6) + 0.0 AS total FROM (WITH {ELEMENTS} SELECT * FROM el) GROUP BY row_id")
def tensor_scan(spark, sf_dir):
    """A folder's tensors by file, in order, in the long form."""
    scanned = tensorfiles.scan(spark, f"{sf_dir}/embeddings.parquet", row="vec_id", values="embedding").withColumn("file", F.lit("embeddings.parquet"))
    rows = tensorfiles.elements(scanned).withColumnRenamed("tensor_id", "file").join(F.broadcast(tensorfiles.ordinals(scanned)), "file")
    out = rows.groupBy("file", F.col("ordinal").cast("bigint").alias("ordinal"), "row_id").agg(F.count("*").alias("channels"), F.sum(F.col("value").cast("double")).alias("total"))
    return rounded(out, 6, "total")


@query("cost_lookup", "SELECT l_orderkey, l_linenumber, p_retailprice FROM lineitem JOIN part ON p_partkey = l_partkey")
def cost_lookup(spark, sf_dir):
    costs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("payload"), "p_retailprice")
    payloads = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("payload"), "l_orderkey", "l_linenumber")
    return tensorfiles.candidates_for(costs, payloads, "payload").select("l_orderkey", "l_linenumber", "p_retailprice")


@query("dry_run_manifest", "SELECT printf('l%02d_%s', layer, kind) AS name, 8 * 512 * 128 * 2 AS bytes_per_request, 'bf16' AS dtype FROM (SELECT unnest(range(4)) AS layer), (VALUES ('k'), ('v')) t(kind)")
def dry_run_manifest(spark, sf_dir):
    made = tensorfiles.dry_run_manifest(spark, "dry", 4, 8, 512, 128)
    return made.select(F.explode("tensors").alias("t")).select("t.name", "t.bytes_per_request", "t.dtype")


@query(
    "axis_predictability_3d",
    f"""WITH {ELEMENTS}, f AS (SELECT label, row_id % 5 AS h, row_id // 5 AS s, channel AS ch, CAST(v AS DOUBLE) AS v FROM el),
    d AS (SELECT label, v, v - lag(v) OVER (PARTITION BY label, s, ch ORDER BY h) AS dh, v - lag(v) OVER (PARTITION BY label, h, ch ORDER BY s) AS ds, v - lag(v) OVER (PARTITION BY label, h, s ORDER BY ch) AS dc FROM f)
    SELECT label AS tensor_id, round(stddev_pop(dh) / stddev_pop(v), 6) AS head, round(stddev_pop(ds) / stddev_pop(v), 6) AS token, round(stddev_pop(dc) / stddev_pop(v), 6) AS channel FROM d GROUP BY label""",
)
def axis_predictability_3d(spark, sf_dir):
    rows = matrices(spark, sf_dir).select("tensor_id", F.pmod("row_id", F.lit(5)).alias("h"), F.floor(F.col("row_id") / 5).alias("s"), F.col("channel").alias("ch"), "value")
    return rounded(stats.axis_predictability(rows, {"head": (["s", "ch"], "h"), "token": (["h", "ch"], "s"), "channel": (["h", "s"], "ch")}), 6, "head", "token", "channel")


@query("scale_spread_tokens", f"WITH {ELEMENTS}, s AS (SELECT label, row_id, max(abs(CAST(v AS DOUBLE))) AS x FROM el GROUP BY ALL) SELECT label AS tensor_id, round(max(x) / median(x), 6) AS max_over_median, round(stddev_pop(x) / avg(x), 6) AS cv FROM s GROUP BY label")
def scale_spread_tokens(spark, sf_dir):
    return rounded(stats.scale_spread(matrices(spark, sf_dir), "row_id"), 6, "max_over_median", "cv")


@query("byte_errors", "WITH e AS (SELECT l_partkey % 20 AS doc, 100 * abs(l_quantity / (1 + l_tax) - l_quantity / (1 + l_discount)) / (l_quantity / (1 + l_discount)) AS rel FROM lineitem), g AS (SELECT doc, avg(rel) AS m FROM e GROUP BY doc) SELECT round((SELECT avg(rel) FROM e), 9) AS byte_mape, round(avg(m), 9) AS mean_group_byte_mape FROM g")
def byte_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("doc"), "l_quantity", (1 + F.col("l_discount")).alias("ratio"), (1 + F.col("l_tax")).alias("predicted"))
    return rounded(resample.byte_errors(rows, "doc", "l_quantity", "ratio", "predicted"), 9, "byte_mape", "mean_group_byte_mape")


@query("scored_bytes", "SELECT user_id AS doc, event_type AS arm, round(sum(value), 6) AS nll_sum, count(value) AS ntok, CAST(sum(length(props)) AS BIGINT) AS payload_bytes, CAST(sum(2 * length(props)) AS BIGINT) AS raw_bytes FROM events GROUP BY ALL")
def scored_bytes(spark, sf_dir):
    """Scores of each document and arm with the bytes that its tensors take."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("arm"), F.col("value").alias("nll"), F.length("props").alias("n"))
    sizes = rows.groupBy("doc", "arm").agg(F.sum("n").alias("payload_bytes"), F.sum(2 * F.col("n")).alias("raw_bytes"))
    return rounded(quality.document_scores(rows).join(sizes, ["doc", "arm"]).drop("mean_nll"), 6, "nll_sum")


@query("contrast_interval")
def contrast_interval(spark, sf_dir):
    """Interval of the mean interaction over documents."""
    rows = quality.contrast_2x2(_baseline(spark, sf_dir), *_arms(spark, sf_dir)[:4]).withColumn("all", F.lit("all"))
    ci = resample.bootstrap_interval(rows, "all", "doc", "interaction", draws=5000, seed=3).drop("all")
    return rounded(ci.withColumn("crosses_zero", trials.crosses_zero("low", "high")), 6, "low", "high")


@query("mae_interval")
def mae_interval(spark, sf_dir):
    """Interval of the mean of the documents' errors of ridge models."""
    rows, folds = _regression(spark, sf_dir)
    return rounded(resample.mae_interval(resample.ridge_cross_validation(rows, folds, "doc", ["x1", "x2"], "y"), "doc", "y"), 6, "low", "high")


@query("prediction_gain")
def prediction_gain(spark, sf_dir):
    """How much models with all features better those with one, and those the mean alone, in percent."""
    rows, folds = _regression(spark, sf_dir)
    mae = lambda xs: resample.error_summary(resample.ridge_cross_validation(rows, folds, "doc", xs, "y"), "doc", "y", "predicted").select(F.col("mae"), F.col("constant_mae"))
    both = mae(["x1", "x2"]).select(F.col("mae").alias("all_mae"), "constant_mae").crossJoin(mae(["x1"]).select(F.col("mae").alias("one_mae")))
    return both.select("all_mae", "one_mae", "constant_mae", tables.improvement(F.col("all_mae"), F.col("one_mae")).alias("features_pct"), tables.improvement(F.col("one_mae"), F.col("constant_mae")).alias("one_pct"))

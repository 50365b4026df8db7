"""Queries over trials, cost model, quality scores, grids, corpora and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerics
from ..operators import checks, corpus, grids, policy, quality, resample, stats, trials
from .base import TRIALS, query, rounded, table
from .base import trials as trial_rows

# ---- trials ----

_Q = "list_sort(list(compressed_s / raw_s))[CAST(floor({f} * (count(*) - 1)) AS BIGINT) + 1]"


@query(
    "paired_ratio_by_path",
    f"WITH {TRIALS} SELECT cache, path, count(*) AS pairs, round(median(raw_s), 6) AS raw_median_s, round(median(compressed_s), 6) AS compressed_median_s, round({_Q.format(f=0.25)}, 9) AS ratio_q25, round({_Q.format(f=0.75)}, 9) AS ratio_q75, round(exp(avg(ln(compressed_s / raw_s))), 9) AS ratio FROM trials GROUP BY ALL",
)
def paired_ratio_by_path(spark, sf_dir):
    out = trials.paired_summary(trial_rows(spark, sf_dir), ["cache", "path"])
    return rounded(rounded(out, 6, "raw_median_s", "compressed_median_s"), 9, "ratio_q25", "ratio_q75", "ratio")


@query("ratio_rollup_segment", f"WITH {TRIALS} SELECT path, segment, round(exp(avg(ln(compressed_s / raw_s))), 9) AS ratio, count(*) AS pairs FROM trials GROUP BY GROUPING SETS ((path, segment), (path))")
def ratio_rollup_segment(spark, sf_dir):
    return rounded(trials.ratio_rollup(trial_rows(spark, sf_dir), ["path"], "segment"), 9, "ratio")


@query("bootstrap_ratio_ci")
def bootstrap_ratio_ci(spark, sf_dir):
    rows = trial_rows(spark, sf_dir).withColumn("unit", F.col("pair") * 10_000_000_000 + F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey"))
    ci = resample.ratio_interval(rows, "path", "unit", draws=5000, seed=1)
    return rounded(ci.withColumn("verdict", trials.ratio_verdict("low", "high")), 6, "low", "high")


@query("offsets_prefix_sum", "SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM lineitem")
def offsets_prefix_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("bigint"))
    return trials.exclusive_offsets(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "size").select("l_orderkey", "l_linenumber", "offset")


@query(
    "stage_breakdown",
    "WITH m AS (SELECT o_orderpriority AS cache, o_orderstatus AS stage, median(o_totalprice) AS x FROM orders GROUP BY ALL) SELECT cache, stage, round(x, 6) AS median_s, round(x / sum(x) OVER (PARTITION BY cache), 9) AS share, round(sum(x) OVER (PARTITION BY cache ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS upto_s FROM m",
)
def stage_breakdown(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cache"), F.col("o_orderstatus").alias("stage"), "o_totalprice")
    return rounded(rounded(trials.stage_breakdown(rows, ["cache"], "stage", "o_totalprice"), 6, "median_s", "upto_s"), 9, "share")


@query(
    "host_residual",
    "WITH m AS (SELECT o_orderpriority AS cache, o_orderstatus AS stage, median(o_totalprice) AS x FROM orders GROUP BY ALL) SELECT cache, round(sum(x) FILTER (WHERE stage <> 'P'), 6) AS stages_s, round(max(x) FILTER (WHERE stage = 'P'), 6) AS total_s, round(max(x) FILTER (WHERE stage = 'P') - sum(x) FILTER (WHERE stage <> 'P'), 6) AS residual_s FROM m GROUP BY cache",
)
def host_residual(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cache"), F.col("o_orderstatus").alias("stage"), "o_totalprice")
    return rounded(trials.host_residual(rows, ["cache"], "stage", "o_totalprice", "P"), 6, "stages_s", "total_s", "residual_s")


@query("bandwidth_by_mode", "SELECT l_returnflag, round(max(l_extendedprice) / 1e9 / median(l_quantity), 12) AS gbps, round(median(l_quantity) * 1e3, 6) AS ms, round(list_sort(list(l_quantity))[-2] * 1e3, 6) AS p95_ms FROM lineitem GROUP BY 1")
def bandwidth_by_mode(spark, sf_dir):
    out = trials.bandwidth(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return rounded(rounded(out, 6, "ms", "p95_ms"), 12, "gbps")


@query(
    "overlap_verdicts",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS a, l_tax * 500 + 1 AS b, l_quantity + l_discount * 100 AS t FROM lineitem)
    SELECT *, round(1 - (t - greatest(a, b)) / least(a, b), 9) AS efficiency, round((a + b - t) / least(a, b), 9) AS share,
    CASE WHEN t < 0.9 * greatest(a, b) THEN 'inconsistent' WHEN 1 - (t - greatest(a, b)) / least(a, b) >= 0.85 THEN 'overlaps' WHEN 1 - (t - greatest(a, b)) / least(a, b) <= 0.10 THEN 'serial' ELSE 'partial' END AS verdict,
    coalesce(t / b > 0.85 AND t / b < 1.15, false) AS control_ok FROM x""",
)
def overlap_verdicts(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("a"), (F.col("l_tax") * 500 + 1).alias("b"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("t"))
    out = x.select("*", trials.overlap_efficiency("a", "b", "t").alias("efficiency"), trials.overlap_share("a", "b", "t").alias("share"), trials.overlap_verdict("a", "b", "t").alias("verdict"), trials.control_gate("t", "b").alias("control_ok"))
    return rounded(out, 9, "efficiency", "share")


@query("bound_by_stage", "WITH m AS (SELECT l_returnflag AS cache, l_linenumber AS stage, median(l_extendedprice) AS x FROM lineitem GROUP BY ALL) SELECT cache, stage, round(x, 6) AS busy_s FROM m QUALIFY row_number() OVER (PARTITION BY cache ORDER BY x DESC, stage) = 1")
def bound_by_stage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cache"), F.col("l_linenumber").alias("stage"), "l_extendedprice")
    return rounded(trials.bound_by(rows, ["cache"], "stage", "l_extendedprice"), 6, "busy_s")


@query("balanced_arm_order", "SELECT o_orderstatus AS path, count(*) AS pairs, count(*) // 2 AS raw_first FROM orders GROUP BY 1")
def balanced_arm_order(spark, sf_dir):
    """Half of the pairs of each path start with the raw arm."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("path"), F.col("o_orderkey").alias("pair"))
    return trials.balanced_order(rows, ["path"], "pair", 3).groupBy("path").agg(F.count("*").alias("pairs"), F.count_if("raw_first").alias("raw_first"))


# ---- cost model ----


def _payloads(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("payload"), (F.col("p_size") * 1_000_000).cast("bigint").alias("original_bytes"), "p_retailprice")


def _candidates(spark, sf_dir):
    widths = F.explode(F.array(*[F.struct(F.lit(i).alias("cand_ord"), F.lit(w).alias("bit_width")) for i, w in enumerate((4, 6, 8))]))
    rows = _payloads(spark, sf_dir).select("*", widths.alias("w")).select("payload", "original_bytes", "p_retailprice", "w.*")
    return rows.select(
        "payload", "original_bytes", "cand_ord", F.concat(F.lit("w"), F.col("bit_width").cast("string")).alias("label"), F.lit("codec").alias("mode"), "bit_width",
        F.floor(F.col("original_bytes") * F.col("bit_width") / 16).cast("bigint").alias("compressed_bytes"), (F.col("p_retailprice") * F.col("bit_width") / 1e7).alias("t_encode_s"), (F.col("p_retailprice") / 1e7).alias("t_decode_s"),
        (F.pmod(F.col("payload") + F.col("cand_ord"), F.lit(7)) != 0).alias("quality_ok"),
    )


def _grid(spark, values, name):
    return spark.createDataFrame([(float(v),) for v in values], [name])


BANDWIDTHS, MARGINS = (1, 5, 12.5, 32, 64, 450), (0, 0.0001, 0.001)
_POLICY = f"""pay AS (SELECT p_partkey AS payload, CAST(p_size AS BIGINT) * 1000000 AS original_bytes, p_retailprice FROM part),
cand AS (SELECT payload, original_bytes, o AS cand_ord, 'w' || w AS label, CAST(floor(original_bytes * w / 16) AS BIGINT) AS compressed_bytes, p_retailprice * w / 1e7 AS enc, p_retailprice / 1e7 AS dec, (payload + o) % 7 <> 0 AS quality_ok FROM pay, (VALUES (0, 4), (1, 6), (2, 8)) c(o, w)),
grid AS (SELECT payload, original_bytes, bw, margin FROM pay, (VALUES {', '.join(f'(CAST({float(b)} AS DOUBLE))' for b in BANDWIDTHS)}) b(bw), (VALUES {', '.join(f'(CAST({float(m)} AS DOUBLE))' for m in MARGINS)}) m(margin)),
net AS (SELECT g.payload, g.bw, g.margin, c.label, c.cand_ord, c.compressed_bytes, c.enc + c.dec AS cost, g.original_bytes / (g.bw * 1e9) - c.compressed_bytes / (g.bw * 1e9) - (c.enc + c.dec + g.margin) AS net_s FROM grid g JOIN cand c USING (payload) WHERE c.quality_ok),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payload, bw, margin ORDER BY net_s DESC, cand_ord) AS place FROM net WHERE net_s > 0) WHERE place = 1),
decision AS (SELECT g.payload, g.bw AS bw_gbps, g.margin AS margin_s, coalesce(b.label, 'passthrough') AS label, coalesce(b.net_s, 0) AS predicted_saving_s, coalesce(b.cost, 0) AS codec_cost_s, g.original_bytes AS bytes_before, coalesce(b.compressed_bytes, g.original_bytes) AS bytes_after, CASE WHEN b.label IS NULL THEN 'not_profitable' ELSE 'none' END AS bypass_reason FROM grid g LEFT JOIN best b ON b.payload = g.payload AND b.bw = g.bw AND b.margin = g.margin)"""


@query("policy_decide", f"WITH {_POLICY} SELECT payload, bw_gbps, margin_s, label, round(predicted_saving_s, 12) AS predicted_saving_s, round(codec_cost_s, 12) AS codec_cost_s, bytes_before, bytes_after, bypass_reason FROM decision")
def policy_decide(spark, sf_dir):
    out = policy.decide(_payloads(spark, sf_dir), _candidates(spark, sf_dir), _grid(spark, BANDWIDTHS, "bw_gbps"), _grid(spark, MARGINS, "margin_s"))
    return rounded(out.drop("considered", "mode"), 12, "predicted_saving_s", "codec_cost_s")


@query(
    "policy_regret",
    f"""WITH {_POLICY}, real AS (SELECT d.*, coalesce(d.bytes_before / (bw_gbps * 1e9) - c.compressed_bytes / (bw_gbps * 1e9) - (c.enc + c.dec), 0) AS realised FROM decision d LEFT JOIN cand c ON c.payload = d.payload AND c.label = d.label)
    SELECT r.margin_s, count(*) AS cells, round(sum(o.realised - r.realised), 9) AS total_regret_s, round(avg(o.realised - r.realised), 9) AS mean_regret_s, count(*) FILTER (WHERE r.label <> o.label) AS flips, round(avg(CASE WHEN r.label = 'passthrough' THEN 1 ELSE 0 END), 9) AS bypass_rate
    FROM real r JOIN real o ON o.payload = r.payload AND o.bw_gbps = r.bw_gbps AND o.margin_s = 0 GROUP BY 1""",
)
def policy_regret(spark, sf_dir):
    out = policy.regret(_payloads(spark, sf_dir), _candidates(spark, sf_dir), _grid(spark, BANDWIDTHS, "bw_gbps"), _grid(spark, MARGINS, "margin_s"))
    return rounded(out, 9, "total_regret_s", "mean_regret_s", "bypass_rate")


@query("policy_considered_log")
def policy_considered_log(spark, sf_dir):
    """What the decision looked at, in candidate order."""
    out = policy.decide(_payloads(spark, sf_dir), _candidates(spark, sf_dir), _grid(spark, [12.5], "bw_gbps"), _grid(spark, [0], "margin_s"))
    return out.select("payload", F.explode("considered").alias("c")).select("payload", "c.label", F.round("c.net_s", 9).alias("net_s"), "c.skipped")


@query("break_even", f"WITH {_POLICY} SELECT payload, label, CASE WHEN original_bytes - compressed_bytes <= 0 THEN 0 WHEN enc + dec <= 0 THEN CAST('inf' AS DOUBLE) ELSE round((original_bytes - compressed_bytes) / ((enc + dec) * 1e9), 6) END AS break_even_gbps, CASE WHEN 12.5 < (original_bytes - compressed_bytes) / ((enc + dec) * 1e9) THEN 'COMPRESS' ELSE 'BYPASS' END AS verdict FROM cand")
def break_even(spark, sf_dir):
    be = policy.break_even_gbps("original_bytes", "compressed_bytes", F.col("t_encode_s") + F.col("t_decode_s"))
    return _candidates(spark, sf_dir).select("payload", "label", F.round(be, 6).alias("break_even_gbps"), policy.transport_verdict(F.lit(12.5), be).alias("verdict"))


@query("bw_sweep", f"WITH {_POLICY} SELECT payload, step, round(pow(10.0, -1 + step * 4.0 / 255), 6) AS bw_gbps, round((original_bytes - compressed_bytes) / (pow(10.0, -1 + step * 4.0 / 255) * 1e9) - (enc + dec), 9) + 0.0 AS net_s FROM (SELECT *, unnest(range(256)) AS step FROM cand WHERE cand_ord = 1)")
def bw_sweep(spark, sf_dir):
    costs = _candidates(spark, sf_dir).where("cand_ord = 1").select("payload", "original_bytes", "compressed_bytes", (F.col("t_encode_s") + F.col("t_decode_s")).alias("cost_s"))
    return rounded(rounded(policy.sweep(costs).select("payload", "step", "bw_gbps", "net_s"), 6, "bw_gbps"), 9, "net_s")


# ---- quality ----


def _tokens(spark, sf_dir):
    w = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("arm"), F.col("value").alias("nll"), "event_id", "ts")
    return w


_SCORES = "sc AS (SELECT user_id AS doc, event_type AS arm, sum(value) AS nll_sum, count(value) AS ntok, avg(value) AS mean_nll FROM events GROUP BY ALL)"
_BASE = "view"


def _baseline(spark, sf_dir):
    return quality.document_scores(_tokens(spark, sf_dir))


@query("document_scores", f"WITH {_SCORES} SELECT doc, arm, round(nll_sum, 6) AS nll_sum, ntok, round(mean_nll, 9) AS mean_nll FROM sc")
def document_scores(spark, sf_dir):
    return rounded(rounded(_baseline(spark, sf_dir), 9, "mean_nll"), 6, "nll_sum")


_ARM0 = "(SELECT min(event_type) FROM events)"


def _arms(spark, sf_dir):
    return [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]


@query("quality_delta_by_doc", f"WITH {_SCORES} SELECT a.doc, a.arm, round(a.mean_nll - b.mean_nll, 9) AS delta FROM sc a JOIN sc b ON b.doc = a.doc AND b.arm = {_ARM0} WHERE a.arm <> {_ARM0}")
def quality_delta_by_doc(spark, sf_dir):
    return rounded(quality.deltas(_baseline(spark, sf_dir), _arms(spark, sf_dir)[0]).select("doc", "arm", "delta"), 9, "delta")


@query(
    "quality_delta_summary",
    f"WITH {_SCORES}, d AS (SELECT a.arm, a.mean_nll - b.mean_nll AS delta FROM sc a JOIN sc b ON b.doc = a.doc AND b.arm = {_ARM0} WHERE a.arm <> {_ARM0}) SELECT arm, count(*) AS docs, round(avg(delta), 9) AS mean_delta, round(max(delta), 9) AS max_delta, count(*) FILTER (WHERE delta > 0) AS worse, round(100 * (exp(avg(delta)) - 1), 6) AS ppl_pct FROM d GROUP BY arm",
)
def quality_delta_summary(spark, sf_dir):
    out = quality.delta_summary(quality.deltas(_baseline(spark, sf_dir), _arms(spark, sf_dir)[0]))
    return rounded(rounded(out, 9, "mean_delta", "max_delta"), 6, "ppl_pct")


@query("arm_totals", "SELECT event_type AS arm, round(sum(value) / count(value), 9) AS mean_nll, count(value) AS ntok FROM events GROUP BY 1")
def arm_totals(spark, sf_dir):
    return rounded(quality.arm_totals(_baseline(spark, sf_dir)).select("arm", "mean_nll", "ntok"), 9, "mean_nll")


def _arm_sql(k: int) -> str:
    return f"(SELECT list_sort(list(DISTINCT event_type))[{k}] FROM events)"


@query(
    "quality_contrast_2x2",
    f"WITH {_SCORES} SELECT a.doc, round(a.mean_nll - b.mean_nll - c.mean_nll + d.mean_nll, 9) AS interaction FROM sc a JOIN sc b ON b.doc = a.doc AND b.arm = {_arm_sql(2)} JOIN sc c ON c.doc = a.doc AND c.arm = {_arm_sql(3)} JOIN sc d ON d.doc = a.doc AND d.arm = {_arm_sql(4)} WHERE a.arm = {_arm_sql(1)}",
)
def quality_contrast_2x2(spark, sf_dir):
    return rounded(quality.contrast_2x2(_baseline(spark, sf_dir), *_arms(spark, sf_dir)[:4]), 9, "interaction")


@query("bootstrap_delta_ci")
def bootstrap_delta_ci(spark, sf_dir):
    d = quality.deltas(_baseline(spark, sf_dir), _arms(spark, sf_dir)[0])
    ci = resample.bootstrap_interval(d, "arm", "doc", "delta", draws=5000, seed=2)
    return rounded(ci.withColumn("crosses_zero", trials.crosses_zero("low", "high")), 6, "low", "high")


@query(
    "shift_test",
    """WITH s AS (SELECT user_id AS doc, ts, event_id, value AS a, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS b FROM events),
    m AS (SELECT doc, k, a, CASE k WHEN -2 THEN lag(b, 2) OVER w WHEN -1 THEN lag(b, 1) OVER w WHEN 0 THEN b WHEN 1 THEN lead(b, 1) OVER w ELSE lead(b, 2) OVER w END AS y FROM s, (VALUES (-2), (-1), (0), (1), (2)) t(k) WINDOW w AS (PARTITION BY doc, k ORDER BY ts, event_id)),
    g AS (SELECT doc, k, avg(abs(a - y)) AS d FROM m WHERE y IS NOT NULL GROUP BY ALL)
    SELECT doc, k AS shift, round(d, 9) AS mean_abs_diff, row_number() OVER (PARTITION BY doc ORDER BY d, k) = 1 AS best FROM g""",
)
def shift_test(spark, sf_dir):
    from pyspark.sql import Window

    t = _tokens(spark, sf_dir)
    t = t.withColumn("b", F.coalesce(F.lag("nll").over(Window.partitionBy("doc").orderBy("ts", "event_id")), F.lit(0.0)))
    return rounded(quality.shift_test(t, ["doc"], ["ts", "event_id"], "nll", "b"), 9, "mean_abs_diff")


@query(
    "compare_tokens",
    "WITH x AS (SELECT user_id AS doc, value AS a, round(value, 1) AS b FROM events) SELECT doc, round(avg(abs(a - b)), 9) AS mean_abs, round(median(abs(a - b)), 9) AS median_abs, round(max(abs(a - b)), 9) AS max_abs, count(*) FILTER (WHERE abs(a - b) > 0.04) AS large, round(abs(avg(a - b)), 9) AS mean_gap FROM x GROUP BY doc",
)
def compare_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.col("value").alias("nll"))
    return rounded(quality.compare_tokens(t, t.withColumn("nll", F.round("nll", 1)), ["doc"], 0.04), 9, "mean_abs", "median_abs", "max_abs", "mean_gap")


@query("next_token_targets", "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events")
def next_token_targets(spark, sf_dir):
    from pyspark.sql import Window

    t = table(spark, sf_dir, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return quality.next_token_targets(t, "user_id", "pos", "event_id").select("event_id", "target")


@query("cross_entropy", "SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))))) - CAST(embedding[label + 1] AS DOUBLE), 6) AS nll FROM embeddings")
def cross_entropy(spark, sf_dir):
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(numerics.cross_entropy(logits, F.col("label")), 6).alias("nll"))


# ---- statistics over samples ----


@query(
    "quantile_family",
    """SELECT event_type, round(median(value), 9) AS mid, round(quantile_cont(value, 0.95), 9) AS linear95, list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS index95, list_sort(list(value))[-2] AS second,
    list_sort(list(value))[CAST(floor(count(*) / 4.0) AS BIGINT) + 1] AS q1, list_sort(list(value))[95] AS place95 FROM events GROUP BY 1""",
)
def quantile_family(spark, sf_dir):
    v = F.array_sort(F.collect_list("value"))
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("mid"), numerics.linear_quantile("value", 0.95).alias("linear95"), numerics.index_quantile("value", 0.95).alias("index95"), numerics.from_end("value", 2).alias("second"), numerics.count_quantile("value", 1, 4).alias("q1"), F.get(v, F.lit(94)).alias("place95"))
    return rounded(out, 9, "mid", "linear95")


@query(
    "variance_cv",
    "WITH p AS (SELECT event_type, user_id % 10 AS process, median(value) AS mid, stddev_pop(value) / avg(value) AS cv FROM events GROUP BY ALL) SELECT event_type, count(*) AS processes, round(median(cv), 6) AS cv_within, round(stddev_pop(mid) / avg(mid), 6) AS cv_between, round(max(mid) / min(mid), 6) AS spread FROM p GROUP BY 1",
)
def variance_cv(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("process", F.pmod("user_id", F.lit(10)))
    return rounded(stats.variance_within_between(rows, ["event_type"], "process", "value"), 6, "cv_within", "cv_between", "spread")


@query("quartile_summary", "SELECT event_type, min(value) AS least, list_sort(list(value))[count(*) // 4 + 1] AS q1, round(median(value), 9) AS mid, list_sort(list(value))[3 * count(*) // 4 + 1] AS q3, max(value) AS most, count(*) FILTER (WHERE value >= 90) AS above FROM events GROUP BY 1")
def quartile_summary(spark, sf_dir):
    return rounded(stats.quartile_summary(table(spark, sf_dir, "events"), ["event_type"], "value", 90), 9, "mid")


@query("knob_reachability", "SELECT l_partkey, count(DISTINCT l_quantity) AS distinct_values, round((max(l_quantity) - min(l_quantity)) / min(l_quantity) * 100, 6) AS spread_pct, count(DISTINCT l_quantity) > 1 AS reachable FROM lineitem GROUP BY 1")
def knob_reachability(spark, sf_dir):
    return rounded(stats.distinct_values(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity"), 6, "spread_pct")


# ---- grids ----


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("tensor"), F.concat_ws("/", F.col("l_linenumber").cast("string"), "l_returnflag").alias("config"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10) / 1000).alias("ratio"), "l_orderkey")


_SCORED = "g AS (SELECT l_partkey % 50 AS tensor, l_linenumber || '/' || l_returnflag AS config, floor(l_extendedprice / l_quantity * 10) / 1000 AS ratio, l_orderkey FROM lineitem)"


@query("best_config_per_tensor", f"WITH {_SCORED} SELECT tensor, b.config AS best_label, b.ratio AS best_score FROM (SELECT tensor, max({{'ratio': ratio, 'config': config}}) AS b FROM g GROUP BY tensor)")
def best_config_per_tensor(spark, sf_dir):
    return grids.best_by_tag(_scored(spark, sf_dir), ["tensor"], "ratio", "config")


@query("first_best_config", f"WITH {_SCORED} SELECT tensor, config, ratio FROM (SELECT *, row_number() OVER (PARTITION BY tensor ORDER BY ratio DESC, l_orderkey, config) AS place FROM g) WHERE place = 1")
def first_best_config(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("ord", F.struct("l_orderkey", "config"))
    return grids.first_best(rows, ["tensor"], "ratio", "ord").select("tensor", "config", "ratio")


@query("frozen_choice_top8", f"WITH {_SCORED}, m AS (SELECT config, avg(ratio) AS s, count(*) AS cells FROM g GROUP BY 1) SELECT config, round(s, 9) AS mean_score, cells, rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, config) AS rank FROM m) WHERE rank <= 8")
def frozen_choice_top8(spark, sf_dir):
    return rounded(grids.frozen_choice(_scored(spark, sf_dir), "config", "ratio"), 9, "mean_score")


@query(
    "best_against_fixed",
    f"WITH {_SCORED}, b AS (SELECT tensor, max({{'ratio': ratio, 'config': config}}) AS b FROM g GROUP BY 1), f AS (SELECT tensor, max(ratio) AS fixed FROM g WHERE config = '1/N' GROUP BY 1) SELECT count(*) AS cells, count(*) FILTER (WHERE b.config = '1/N') AS fixed_wins, round(avg(b.ratio / fixed), 9) AS mean_gain, round(min(b.ratio / fixed), 9) AS min_gain, round(max(b.ratio / fixed), 9) AS max_gain FROM b JOIN f USING (tensor)",
)
def best_against_fixed(spark, sf_dir):
    return rounded(grids.best_against_fixed(_scored(spark, sf_dir), ["tensor"], "config", "ratio", "1/N"), 9, "mean_gain", "min_gain", "max_gain")


@query("config_grid", "SELECT algo, c, direction, 'algo=' || algo || ',c=' || c || ',direction=' || direction AS tag FROM (VALUES ('lorenzo'), ('nopred')) a(algo), (VALUES ('0.01'), ('0.1')) b(c), (VALUES ('0'), ('1'), ('2')) d(direction)")
def config_grid(spark, sf_dir):
    g = grids.config_grid(spark, {"algo": ["lorenzo", "nopred"], "c": ["0.01", "0.1"], "direction": ["0", "1", "2"]})
    return g.select("*", grids.tag(F.create_map(*[x for c in ("direction", "algo", "c") for x in (F.lit(c), F.col(c))])).alias("tag"))


# ---- corpora ----


def _corpus(spark, sf_dir):
    title = F.concat_ws("-", "source", "lang")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), title.alias("title"), F.col("doc_id").alias("corpus_index"), F.col("text").alias("body"), F.floor(F.col("n_chars") / 4).alias("n_tokens"), "source")


def _seen(spark, sf_dir):
    dev = _corpus(spark, sf_dir).where("source IN ('src1', 'src2')")
    return dev.select("title", numerics.short_hash(numerics.squeeze_spaces("body")).alias("body_hash"))


_FREEZE = """docs AS (SELECT doc_id AS doc, source || '-' || lang AS title, doc_id AS corpus_index, length(text) AS n_chars, n_chars // 4 AS n_tokens, source, substr(sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS body_hash FROM documents),
seen AS (SELECT title, body_hash FROM docs WHERE source IN ('src1', 'src2')),
r0 AS (SELECT *, CASE WHEN n_chars < 3000 THEN 'too_short' WHEN title IN (SELECT title FROM seen) THEN 'title_seen' WHEN body_hash IN (SELECT body_hash FROM seen) THEN 'body_seen' WHEN n_tokens < 800 THEN 'too_few_tokens' END AS r FROM docs),
cl AS (SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY body_hash, r IS NULL ORDER BY corpus_index, doc) > 1 THEN 'body_repeated' ELSE r END AS reason FROM r0),
held AS (SELECT *, row_number() OVER (ORDER BY corpus_index, doc) - 1 AS k FROM cl WHERE reason IS NULL QUALIFY k < 32)"""


@query("freeze_heldout", f"WITH {_FREEZE} SELECT 'h' || lpad(CAST(k AS VARCHAR), 2, '0') AS held_id, doc, title, corpus_index, n_chars, body_hash FROM held")
def freeze_heldout(spark, sf_dir):
    return corpus.freeze_held_out(corpus.classify(_corpus(spark, sf_dir), _seen(spark, sf_dir), 3000, 800), 32)


@query("rejected_reasons", f"WITH {_FREEZE} SELECT doc, corpus_index, reason FROM cl WHERE reason IS NOT NULL AND ((SELECT count(*) FROM held) < 32 OR corpus_index < (SELECT max(corpus_index) FROM held)) ORDER BY corpus_index, doc LIMIT 80")
def rejected_reasons(spark, sf_dir):
    classified = corpus.classify(_corpus(spark, sf_dir), _seen(spark, sf_dir), 3000, 800)
    return corpus.rejected(classified, corpus.freeze_held_out(classified, 32), 32)


@query(
    "seen_union",
    """WITH u AS (SELECT source || '-' || lang AS title, 'train' AS split, 'tuning' AS used_by, doc_id AS ord, substr(sha1(text), 1, 16) AS h FROM documents WHERE doc_id % 2 = 0 UNION ALL
    SELECT source || '-' || lang, 'test', 'labels', d.doc_id, substr(sha1(text), 1, 16) FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
    SELECT title, f.h AS body_hash, f.split AS split, used_by FROM (SELECT title, min({'ord': ord, 'h': h, 'split': split}) AS f, array_to_string(list_sort(list(DISTINCT used_by)), ',') AS used_by FROM u GROUP BY title)""",
)
def seen_union(spark, sf_dir):
    docs = _corpus(spark, sf_dir).withColumn("ord", F.col("doc"))
    a = docs.where("doc % 2 = 0").select("title", "body", "ord", F.lit("train").alias("split"), F.lit("tuning").alias("used_by"))
    b = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc")), "doc").select("title", "body", "ord", F.lit("test").alias("split"), F.lit("labels").alias("used_by"))
    return corpus.seen_documents(a, b).withColumn("used_by", F.array_join("used_by", ","))


@query("unseen_documents", f"WITH {_FREEZE} SELECT doc FROM docs WHERE title NOT IN (SELECT title FROM seen) AND body_hash NOT IN (SELECT body_hash FROM seen)")
def unseen_documents(spark, sf_dir):
    docs = _corpus(spark, sf_dir).withColumn("body_hash", numerics.short_hash(numerics.squeeze_spaces("body")))
    return corpus.unseen(docs, _seen(spark, sf_dir)).select("doc")


@query("labelled_semi", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def labelled_semi(spark, sf_dir):
    return corpus.semi(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "n_chars")


@query("missing_labels", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_labels(spark, sf_dir):
    return corpus.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("plain_text", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents) SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY ord) AS text FROM l WHERE length(trim(line)) > 64 GROUP BY 1")
def plain_text(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return corpus.plain_text(lines, "doc_id", "ord", "line").select("doc_id", "text")


@query("heading_split", "SELECT page_id AS doc, CAST(k AS INT) AS ord, 'p' || k AS title, 'body of ' || url || ' ' || k AS body FROM (SELECT *, unnest(range(3)) AS k FROM pages)")
def heading_split(spark, sf_dir):
    """Articles marked up from the pages' addresses, split again."""
    part = lambda k: F.concat(F.lit(f"\n = p{k} = \n"), F.lit("body of "), F.col("url"), F.lit(f" {k}\n"))
    texts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.concat(F.lit("preface"), *[part(k) for k in range(3)]).alias("text"))
    return corpus.split_headings(texts, "doc", "text")


# ---- resampling and gates ----


@query("group_folds", "WITH s AS (SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1) SELECT conv_id, CAST((row_number() OVER (ORDER BY size DESC, conv_id) - 1) % 6 AS INT) AS fold, size FROM s")
def group_folds(spark, sf_dir):
    return resample.group_folds(table(spark, sf_dir, "conversations"), "conv_id", 6)


def _regression(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 24).alias("doc"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x1"), F.ln(F.col("p_partkey") + 1).alias("x2"))
    return rows, resample.group_folds(rows, "doc", 6)


@query("ridge_cv_errors")
def ridge_cv_errors(spark, sf_dir):
    """Errors of ridge models on folds they never saw, next to predicting the mean."""
    rows, folds = _regression(spark, sf_dir)
    predicted = resample.ridge_cross_validation(rows, folds, "doc", ["x1", "x2"], "y")
    return resample.error_summary(predicted, "doc", "y", "predicted")


@query("forest_cv_errors")
def forest_cv_errors(spark, sf_dir):
    rows, folds = _regression(spark, sf_dir)
    predicted = resample.forest_cross_validation(rows, folds, "doc", ["x1", "x2"], "y")
    return resample.error_summary(predicted, "doc", "y", "predicted")


@query(
    "error_summary",
    "WITH e AS (SELECT l_partkey % 20 AS doc, l_extendedprice AS y, l_extendedprice * (1 - l_discount) AS p FROM lineitem), m AS (SELECT doc, avg(abs(y - p)) AS g FROM e GROUP BY 1) SELECT round(avg(abs(y - p)), 6) AS mae, round(100 * avg(abs((y - p) / y)), 6) AS mape, round((SELECT avg(g) FROM m), 6) AS mean_group_mae, round(avg(abs(y - (SELECT avg(y) FROM e))), 6) AS constant_mae FROM e",
)
def error_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("doc"), F.col("l_extendedprice").alias("y"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"))
    return rounded(resample.error_summary(rows, "doc", "y", "p"), 6, "mae", "mape", "mean_group_mae", "constant_mae")


@query("gate_by_path", "SELECT l_linestatus AS path, l_returnflag AS arm, count(*) AS checks, bool_and(l_discount <= 0.1) AS all_ok, bool_or(l_discount <= 0.1) AS any_ok, count(*) FILTER (WHERE NOT l_discount <= 0.1) AS failing FROM lineitem GROUP BY ALL")
def gate_by_path(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("path"), F.col("l_returnflag").alias("arm"), (F.col("l_discount") <= 0.1).alias("ok"))
    return checks.gate(rows, "ok", ["path", "arm"])


@query("violations_by_mode", "SELECT l_returnflag AS mode, l_linestatus AS c, count(*) AS n, count(*) FILTER (WHERE l_tax > 0.05 + 1e-6) AS \"over\", round(max(l_tax / 0.05), 9) AS worst FROM lineitem GROUP BY ALL")
def violations_by_mode(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("c"), "l_tax", F.lit(0.05).alias("eps"))
    return rounded(checks.violations(rows, ["mode", "c"], "l_tax", "eps"), 9, "worst")


@query("modes_identical", "WITH s AS (SELECT l_orderkey, count(DISTINCT l_quantity) = 1 AS same FROM lineitem GROUP BY 1) SELECT count(*) AS cells, count(*) FILTER (WHERE same) AS identical FROM s")
def modes_identical(spark, sf_dir):
    return checks.modes_identical(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")


@query(
    "reuse_counters",
    "SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 11 = 0) AS fp32_differs, count(*) FILTER (WHERE event_id % 13 = 0) AS bf16_differs, count(*) FILTER (WHERE event_id % 11 = 0 OR event_id % 13 = 0) AS either_differs, CAST(0 AS BIGINT) AS nonfinite FROM events",
)
def reuse_counters(spark, sf_dir):
    fresh = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("fp32"), F.col("value").alias("bf16"))
    off = lambda c, k: F.when(F.col("event_id") % k == 0, F.col(c) + 1).otherwise(F.col(c))
    return checks.reuse_counters(fresh, fresh.select("event_id", off("fp32", 11).alias("fp32"), off("bf16", 13).alias("bf16")), ["event_id"])

"""Cost model and decision rule for moving a smaller payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import col, log_space

#: Nominal bandwidths of fabrics in GB/s.
FABRIC_GBPS = {"NVLink4": 450.0, "PCIe5 x16": 64.0, "PCIe4 x16": 32.0, "400G IB": 50.0, "100G IB": 12.5, "10GbE": 1.25}


def transfer_s(nbytes, gbps) -> Column:
    return col(nbytes) / (col(gbps) * 1e9)


def codec_cost_s(encode, decode, sync=0.0, margin=0.0) -> Column:
    return col(encode) + col(decode) + col(sync) + col(margin)


def net_benefit_s(original, compressed, gbps, cost) -> Column:
    """Seconds saved by moving the smaller payload, less what the codec costs."""
    return transfer_s(original, gbps) - transfer_s(compressed, gbps) - col(cost)


def break_even_gbps(original, compressed, cost) -> Column:
    """The bandwidth below which compression pays: 0 if nothing is saved, infinite if it is free."""
    saved = col(original) - col(compressed)
    return F.when(saved <= 0, 0.0).when(col(cost) <= 0, float("inf")).otherwise(saved / (F.nullif(col(cost), F.lit(0.0)) * 1e9))


def measured_break_even(saved_bytes, total_s, d2h_s, h2d_s) -> Column:
    """Break-even from an end-to-end time without its two copies."""
    return col(saved_bytes) / F.nullif((col(total_s) - col(d2h_s) - col(h2d_s)) * 1e9, F.lit(0.0))


def legacy_break_even(raw_bytes, total_s) -> Column:
    """Payload over total time; kept under this name because it is not a property of a path."""
    return col(raw_bytes) / F.nullif(col(total_s) * 1e9, F.lit(0.0))


def sweep(costs: DataFrame, low: float = 0.1, high: float = 1000.0, n: int = 256) -> DataFrame:
    """Net benefit of each row of (original_bytes, compressed_bytes, cost_s) over a bandwidth grid."""
    rows = costs.select("*", F.posexplode(log_space(low, high, n)).alias("step", "bw_gbps"))
    return rows.withColumn("net_s", net_benefit_s("original_bytes", "compressed_bytes", "bw_gbps", "cost_s"))


def offered(payloads: DataFrame, candidates: DataFrame) -> DataFrame:
    """payload, original_bytes and the payload's candidates in order, null if it has none but passthrough.

    Spark takes exploded candidates for as small as the table behind them, so the join is never left
    to a broadcast: both sides shuffle once, and all that follows works within a row."""
    of = candidates.where("mode <> 'passthrough'").groupBy("payload").agg(F.array_sort(F.collect_list(F.struct("cand_ord", "label", "mode", "compressed_bytes", "t_encode_s", "t_decode_s", "quality_ok"))).alias("candidates"))
    return payloads.select("payload", "original_bytes").join(of.hint("merge"), "payload", "left")


def over_grid(rows: DataFrame, *grids: DataFrame) -> DataFrame:
    """rows at every point of the grids, which are small literal tables."""
    for grid in grids:
        rows = rows.crossJoin(F.broadcast(grid))
    return rows


def considered(margin_s="margin_s") -> Column:
    """label, mode, compressed_bytes, codec_cost_s, net_s, skipped of each of the candidates at a bandwidth and margin; skipped ones say why."""

    def one(c: Column) -> Column:
        cost = codec_cost_s(c["t_encode_s"], c["t_decode_s"])
        skipped = F.when(~c["quality_ok"], "quality")
        net = F.when(skipped.isNull(), net_benefit_s("original_bytes", c["compressed_bytes"], "bw_gbps", cost + col(margin_s)))
        return F.struct(c["label"].alias("label"), c["mode"].alias("mode"), c["compressed_bytes"].alias("compressed_bytes"), cost.alias("codec_cost_s"), net.alias("net_s"), skipped.alias("skipped"))

    return F.transform("candidates", one)


def best_of(log) -> Column:
    """The entry of a log with the largest strictly positive net benefit (ties: the first), else null."""
    nets = F.transform(log, lambda c: c["net_s"])
    most = F.array_max(nets)
    return F.when(most > 0, F.get(log, (F.array_position(nets, most) - 1).cast("int")))


def decide(payloads: DataFrame, candidates: DataFrame, bandwidths: DataFrame, margins: DataFrame) -> DataFrame:
    """The candidate with the largest strictly positive net benefit (ties: the first), else passthrough."""
    rows = over_grid(offered(payloads, candidates), bandwidths, margins).withColumn("log", considered())
    rows = rows.withColumn("best", best_of("log"))
    none = F.col("best").isNull()
    log = F.transform("log", lambda c: F.struct(c["label"].alias("label"), c["net_s"].alias("net_s"), c["skipped"].alias("skipped")))
    return rows.select(
        "payload", "bw_gbps", "margin_s", F.coalesce("best.mode", F.lit("passthrough")).alias("mode"), F.coalesce("best.label", F.lit("passthrough")).alias("label"),
        F.coalesce("best.net_s", F.lit(0.0)).alias("predicted_saving_s"), F.coalesce("best.codec_cost_s", F.lit(0.0)).alias("codec_cost_s"),
        F.col("original_bytes").alias("bytes_before"), F.coalesce("best.compressed_bytes", "original_bytes").alias("bytes_after"),
        F.when(none, "not_profitable").otherwise("none").alias("bypass_reason"), log.alias("considered"),
    )


def realised_s(best) -> Column:
    """The benefit of a chosen candidate without the margin, 0 for passthrough."""
    return F.coalesce(net_benefit_s("original_bytes", col(best)["compressed_bytes"], "bw_gbps", col(best)["codec_cost_s"]), F.lit(0.0))


def regret(payloads: DataFrame, candidates: DataFrame, bandwidths: DataFrame, margins: DataFrame) -> DataFrame:
    """Per margin: total and mean shortfall against deciding without a margin, flips and bypasses."""
    rows = over_grid(offered(payloads.where("payload IS NOT NULL"), candidates), bandwidths, margins)
    rows = rows.withColumn("log", considered()).withColumn("free_log", considered(F.lit(0.0)))
    rows = rows.withColumn("best", best_of("log")).withColumn("free", best_of("free_log"))
    cells = rows.select("margin_s", (realised_s("free") - realised_s("best")).alias("gap"), (F.coalesce("best.label", F.lit("passthrough")) != F.coalesce("free.label", F.lit("passthrough"))).alias("flip"), F.coalesce("best.mode", F.lit("passthrough")).alias("mode"))
    return cells.groupBy("margin_s").agg(F.count("*").alias("cells"), F.sum("gap").alias("total_regret_s"), F.avg("gap").alias("mean_regret_s"), F.count_if("flip").alias("flips"), F.avg((F.col("mode") == "passthrough").cast("int")).alias("bypass_rate"))


def transport_verdict(link_gbps, break_even) -> Column:
    return F.when(col(link_gbps) < col(break_even), "COMPRESS").otherwise("BYPASS")

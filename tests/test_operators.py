"""Operators that need more than one query: streams, manifests, faults, resampling."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import checks, corpus, policy, resample, trials
from quillon.sources import flatfile, manifest
from quillon.streaming import trials as stream


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.lit(0).alias("segment"), (F.col("id") % 2).cast("string").alias("cache"), F.lit("p").alias("path"), F.col("id").alias("pair"), (1 + F.col("id") % 7).cast("double").alias("raw_s"), (2 + F.col("id") % 5).cast("double").alias("compressed_s"))
    rows.repartition(6).write.json(str(tmp_path / "log"))
    q = stream.write_complete(stream.running_ratio(stream.read_trials(spark, str(tmp_path / "log"), 2)), "ratio_test", str(tmp_path / "state"))
    q.awaitTermination()
    got = {r["cache"]: (r["pairs"], round(r["ratio"], 12)) for r in spark.table("ratio_test").collect()}
    want = {r["cache"]: (r["pairs"], round(r["ratio"], 12)) for r in stream.running_ratio(rows).collect()}
    assert got == want


def test_manifest_version(spark, tmp_path):
    for name, version in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"schema_version": version, "corpus_id": "c", "tensors": [{"name": "t", "shape": [2, 3], "extras": {"k": "v"}}]}))
    assert manifest.tensors(manifest.read_manifest(spark, str(tmp_path / "a.json"))).first()["shape"] == [2, 3]
    with pytest.raises(Exception, match="version"):
        manifest.read_manifest(spark, str(tmp_path / "b.json")).collect()


def test_faults_are_all_detected(spark):
    rows = spark.range(400).select((F.col("id") % 2).cast("string").alias("tensor_id"), F.floor(F.col("id") / 2).alias("pos"), (F.col("id") / 100).alias("value")).withColumn("delivered", F.col("value"))
    out = {r["fault"]: r["detected"] for r in checks.fault_suite(rows, 0.05).collect()}
    assert len(out) == 7 and all(out.values())


def test_first_candidate_wins_ties(spark):
    pay = spark.createDataFrame([(1, 1000)], "payload int, original_bytes long")
    cand = spark.createDataFrame([(1, 1000, i, f"c{i}", "codec", 4, 500, 0.0, 0.0, i != 0) for i in range(3)], "payload int, original_bytes long, cand_ord int, label string, mode string, bit_width int, compressed_bytes long, t_encode_s double, t_decode_s double, quality_ok boolean")
    one = lambda name, v: spark.createDataFrame([(v,)], f"{name} double")
    row = policy.decide(pay, cand, one("bw_gbps", 1.0), one("margin_s", 0.0)).first()
    assert row["label"] == "c1" and [c["skipped"] for c in row["considered"]] == ["quality", None, None]
    assert policy.decide(pay, cand, one("bw_gbps", 1.0), one("margin_s", 1.0)).first()["label"] == "passthrough"


def test_group_folds_keep_groups_whole_and_even(spark):
    rows = spark.range(1000).select(F.floor(F.sqrt("id")).alias("g"))
    folds = resample.group_folds(rows, "g", 6).toPandas()
    sizes = folds.groupby("fold")["size"].sum()
    assert folds["g"].is_unique and sizes.max() - sizes.min() < 80


def test_ridge_recovers_a_line_on_unseen_folds(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    data = [(int(i % 30), float(a), float(b), float(3 * a - 2 * b + 1)) for i, (a, b) in enumerate(x)]
    rows = spark.createDataFrame(data, "doc int, x1 double, x2 double, y double")
    out = resample.ridge_cross_validation(rows, resample.group_folds(rows, "doc", 6), "doc", ["x1", "x2"], "y")
    assert resample.error_summary(out, "doc", "y", "predicted").first()["mae"] < 1e-3


def test_bootstrap_interval_holds_the_mean(spark):
    rows = spark.range(200).select(F.lit("k").alias("k"), "id", (F.col("id") % 10).cast("double").alias("v"))
    r = resample.bootstrap_interval(rows, "k", "id", "v", draws=200).first()
    assert r["low"] < 4.5 < r["high"] and r["high"] - r["low"] < 1.5


def test_flat_file_detects_a_short_read(spark):
    pieces = spark.createDataFrame([("f", i, bytearray(b"x" * (i + 1))) for i in range(4)], "file string, ordinal int, content binary")
    offsets = flatfile.offset_table(pieces, "file", "ordinal", "content")
    files = flatfile.concatenate(pieces, "file", "ordinal", "content").withColumn("content", F.expr("substring(content, 1, 8)"))
    assert {r["ordinal"]: r["short_read"] for r in flatfile.read_pieces(files, offsets, "file").collect()} == {0: False, 1: False, 2: False, 3: True}


def test_required_count(spark):
    assert corpus.require_count(spark.range(3), 2, "rows").count() == 3
    with pytest.raises(Exception, match="fewer than"):
        corpus.require_count(spark.range(1), 2, "rows").collect()


def test_rollup_has_a_row_over_all_segments(spark):
    rows = spark.createDataFrame([("p", s, 1.0, 2.0) for s in (0, 1, 1)], "path string, segment int, raw_s double, compressed_s double")
    out = trials.ratio_rollup(rows, ["path"], "segment").collect()
    assert {r["segment"] for r in out} == {0, 1, None} and all(abs(r["ratio"] - 2) < 1e-12 for r in out)


@pytest.mark.parametrize("name", ["policy_regret", "policy_decide", "policy_considered_log"])
def test_policy_broadcasts_literal_grids_alone(spark, tmp_path, name):
    """Candidates are exploded from a table that looks small to Spark: they may not be broadcast."""
    from quillon.plans import registry

    spark.range(50).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") * 7.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan

"""Queries over whole tables, on rows beyond the ids that they once stopped at."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from quillon.plans import registry

from test_queries import check



def folder(tmp_path, name, where):
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.01/{name}.parquet' WHERE {where}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def interval(values, draws=5000):
    """Low and high of the mean of values drawn with replacement, by brute force, and a bound on how
    far another generator's may lie from them."""
    x, rng = np.array(values), np.random.default_rng(9)
    means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(draws)])
    return *np.percentile(means, [2.5, 97.5]), 0.25 * means.std()


def test_bootstrap_ratio_covers_all_orders(spark, tmp_path):
    d = folder(tmp_path, "lineitem", "l_orderkey BETWEEN 50 AND 3000")
    got = {r["path"]: r for r in registry.QUERIES["bootstrap_ratio_ci"](spark, d).collect()}
    rows = duckdb.sql(f"SELECT l_linestatus, ln((1 - l_discount) * (1 + l_tax)) FROM '{d}/lineitem.parquet'").fetchall()
    assert got.keys() == {r[0] for r in rows}
    for path in got:
        low, high, near = interval([v for k, v in rows if k == path])
        assert abs(math.log(got[path]["low"]) - low) < near and abs(math.log(got[path]["high"]) - high) < near


def test_bootstrap_delta_draws_5000(spark, tmp_path):
    d = folder(tmp_path, "events", "user_id <= 90")
    got = {r["arm"]: r for r in registry.QUERIES["bootstrap_delta_ci"](spark, d).collect()}
    rows = duckdb.sql(f"WITH s AS (SELECT user_id AS doc, event_type AS arm, avg(value) AS m FROM '{d}/events.parquet' GROUP BY ALL), z AS (SELECT min(arm) AS arm FROM s) SELECT a.arm, a.m - b.m FROM s a JOIN s b ON b.doc = a.doc AND b.arm = (SELECT arm FROM z) WHERE a.arm <> b.arm ORDER BY a.doc").fetchall()
    for arm in {r[0] for r in rows}:
        low, high, near = interval([v for k, v in rows if k == arm])
        assert abs(got[arm]["low"] - low) < near and abs(got[arm]["high"] - high) < near


@pytest.mark.parametrize("chunk", [3, 4096])
def test_bootstrap_draws_in_chunks(spark, monkeypatch, chunk):
    """Every replicate draws n units: constant values keep their mean exactly; mean and spread fit; reruns agree."""
    from quillon.operators import resample

    monkeypatch.setattr(resample, "CHUNK", chunk)
    units = spark.createDataFrame([("a", i, float(i % 7)) for i in range(40)] + [("b", i, 2.0) for i in range(5)] + [("c", 0, None)], "k string, u long, v double")
    means = lambda: {k: [r["mean"] for r in rows] for k in "ab" if (rows := sorted((r for r in got if r["k"] == k), key=lambda r: r["replicate"]))}
    got = resample.bootstrap_means(units, "k", "u", "v", 2000, 4).collect()
    first = means()
    assert {r["k"] for r in got} == {"a", "b"} and set(first["b"]) == {2.0}
    x = np.array([float(i % 7) for i in range(40)])
    assert abs(np.mean(first["a"]) - x.mean()) < 0.03 and abs(np.std(first["a"]) / (x.std() / math.sqrt(40)) - 1) < 0.08
    got = resample.bootstrap_means(units.repartition(3), "k", "u", "v", 2000, 4).collect()
    assert all(math.isclose(x, y) for x, y in zip(first["a"], means()["a"]))


def whole(duck, name):
    return duck.sql(registry.ORACLES[name])


@pytest.mark.parametrize("name", ["policy_decide", "policy_regret", "break_even"])
def test_policy_covers_all_parts(spark, tmp_path, name):
    d = folder(tmp_path, "part", "p_partkey BETWEEN 390 AND 460")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet'")
    df = registry.QUERIES[name](spark, d)
    check([tuple(r) for r in df.collect()], df.columns, whole(duck, name))


def test_considered_log_covers_all_parts(spark, tmp_path):
    d = folder(tmp_path, "part", "p_partkey BETWEEN 390 AND 460")
    rows = registry.QUERIES["policy_considered_log"](spark, d).collect()
    assert {r["payload"] for r in rows} == set(range(390, 461)) and len(rows) == 71 * 3


def test_sweep_covers_all_parts(spark, tmp_path):
    d = folder(tmp_path, "part", "p_partkey BETWEEN 390 AND 460")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet'")
    want = {(p, k): (bw, net) for p, k, bw, net in whole(duck, "bw_sweep").fetchall()}
    got = {(r["payload"], r["step"]): (r["bw_gbps"], r["net_s"]) for r in registry.QUERIES["bw_sweep"](spark, d).collect()}
    assert got.keys() == want.keys() and len(got) == 71 * 256
    assert all(math.isclose(x, y, abs_tol=2e-9) for k in got for x, y in zip(got[k], want[k]))


def test_manifest_covers_all_orders(spark, tmp_path):
    d = folder(tmp_path, "orders", "o_orderkey BETWEEN 2990 AND 3300")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{d}/orders.parquet'")
    df = registry.QUERIES["manifest_tall"](spark, d)
    check([tuple(r) for r in df.collect()], df.columns, whole(duck, "manifest_tall"))

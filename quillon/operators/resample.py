"""Bootstraps drawn chunk by chunk, grouped folds and models per fold."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Units of a key that are drawn together; their places fit 16 bits.
CHUNK = 4096
_PIECE = 1 << 20


def _generator(seed: int, *names) -> np.random.Generator:
    return np.random.default_rng([seed, *(zlib.crc32(str(n).encode()) for n in names)])


def _deal(draws: int, seed: int):
    """For one key: how many of its n draws of each replicate fall into each chunk."""

    def run(chunks: pa.Table) -> pa.Table:
        order = np.argsort(chunks.column("chunk").to_numpy(), kind="stable")
        m = chunks.column("m").to_numpy()[order]
        times = _generator(seed, chunks.column("boot_key")[0].as_py()).multinomial(m.sum(), m / m.sum(), size=draws).T
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * draws), pa.array(times.astype(np.int64).ravel()))
        return pa.table({"boot_key": chunks.column("boot_key").take(pa.array(order)), "chunk": chunks.column("chunk").to_numpy()[order], "times": out})

    return run


def _draw(seed: int):
    """For one chunk: the sum of the values drawn with replacement, by replicate."""

    def run(units: pa.Table, dealt: pa.Table) -> pa.Table:
        key, chunk = dealt.column("boot_key")[0], dealt.column("chunk")[0].as_py()
        values = units.column("value").to_numpy()[np.argsort(units.column("unit").to_numpy(), kind="stable")]
        times = dealt.column("times").combine_chunks().flatten().to_numpy()
        rng, out, per = _generator(seed, key.as_py(), chunk), np.zeros(len(times)), max(1, _PIECE // max(1, len(values)))
        for a in range(0, len(times), per):
            some = times[a : a + per]
            drawn = values[rng.integers(0, len(values), int(some.sum()), dtype=np.uint16 if len(values) <= 1 << 16 else np.int64)]
            starts, any_ = np.cumsum(some) - some, some > 0
            out[a : a + per][any_] = np.add.reduceat(drawn, starts[any_]) if any_.any() else 0.0
        return pa.table({"boot_key": pa.array([key.as_py()], pa.string()), "sums": pa.array([out], pa.list_(pa.float64()))})

    return run


def bootstrap_means(units: DataFrame, key: str, unit: str, value: str, draws: int, seed: int) -> DataFrame:
    """key, replicate, mean: the mean of value over n units drawn with replacement, draws times.

    Units are dealt into chunks by a hash; one multinomial draw per key and replicate says how often
    each chunk is drawn from, and each chunk then draws by itself. So neither draws nor a key's units ever
    become rows of one task, and reruns agree. Units without a value are left out."""
    rows = units.where(F.col(value).isNotNull()).select(F.col(key).alias("own_key"), F.col(key).cast("string").alias("boot_key"), F.xxhash64(unit).alias("unit"), F.col(value).cast("double").alias("value"))
    sizes = rows.groupBy("own_key", "boot_key").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK)).cast("bigint").alias("chunks"))
    placed = rows.join(sizes.select("boot_key", "chunks"), "boot_key").select("boot_key", F.pmod("unit", "chunks").alias("chunk"), "unit", "value")
    dealt = placed.groupBy("boot_key", "chunk").agg(F.count("*").alias("m")).groupBy("boot_key").applyInArrow(_deal(draws, seed), "boot_key string, chunk bigint, times array<bigint>")
    sums = placed.groupBy("boot_key", "chunk").cogroup(dealt.groupBy("boot_key", "chunk")).applyInArrow(_draw(seed), "boot_key string, sums array<double>")
    total = sums.select("boot_key", F.posexplode("sums").alias("replicate", "drawn")).groupBy("boot_key", "replicate").agg(F.sum("drawn").alias("drawn"))
    return total.join(sizes, "boot_key").select(F.col("own_key").alias(key), "replicate", (F.col("drawn") / F.col("n")).alias("mean"))


def bootstrap_interval(units: DataFrame, key: str, unit: str, value: str, draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """key, low, high: the percentile interval of the mean."""
    a = (1 - level) / 2
    means = bootstrap_means(units, key, unit, value, draws, seed)
    return means.groupBy(key).agg(F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(1 - a)).alias("high"))


def ratio_interval(trials: DataFrame, key: str, unit: str, **options) -> DataFrame:
    """Interval of the geometric-mean ratio compressed_s / raw_s."""
    logs = trials.where("raw_s > 0 AND compressed_s > 0").withColumn("log_ratio", F.ln(F.col("compressed_s") / F.col("raw_s")))
    ci = bootstrap_interval(logs, key, unit, "log_ratio", **options)
    return ci.select(key, F.exp("low").alias("low"), F.exp("high").alias("high"))


def group_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """group, fold: whole groups dealt in turn by descending size, so folds are near equal. One row per
    group is ranked, over buckets of sizes rather than in one task: ties within a size go by a hash."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    per_size = sizes.groupBy("size").agg(F.count("*").alias("groups"))
    before = F.coalesce(F.sum("groups").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = per_size.withColumn("before", before).select("size", "before")
    place = F.row_number().over(Window.partitionBy("size").orderBy(group)) - 1
    return sizes.withColumn("place", place).join(F.broadcast(start), "size").select(group, F.pmod(F.col("before") + F.col("place"), F.lit(folds)).cast("int").alias("fold"), "size")


def error_summary(rows: DataFrame, group: str, truth: str, predicted: str) -> DataFrame:
    """MAE and MAPE over rows, mean of the groups' MAE, and the MAE of predicting the mean."""
    mean = rows.agg(F.avg(truth).alias("mean_truth"))
    e = rows.crossJoin(F.broadcast(mean)).withColumn("abs_err", F.abs(F.col(truth) - F.col(predicted)))
    per = e.groupBy(group).agg(F.avg("abs_err").alias("group_mae"), F.sum("abs_err").alias("err"), F.sum(F.abs(F.col("abs_err") / F.nullif(F.col(truth), F.lit(0.0)))).alias("rel"), F.sum(F.abs(F.col(truth) - F.col("mean_truth"))).alias("const"), F.count("*").alias("n"))
    n = F.sum("n")
    return per.agg((F.sum("err") / n).alias("mae"), (100 * F.sum("rel") / n).alias("mape"), F.avg("group_mae").alias("mean_group_mae"), (F.sum("const") / n).alias("constant_mae"))


#: Ridge penalties that the inner folds choose from.
PENALTIES = tuple(10.0 ** (k / 2) for k in range(-6, 7))


def ridge_cross_validation(rows: DataFrame, folds: DataFrame, group: str, features: list[str], truth: str, inner: int = 3) -> DataFrame:
    """rows with their prediction by ridge models that never saw their fold.

    Every fold needs only the sums X'X, X'y, n of each (fold, inner fold): those are aggregated on the
    executors, so the size of the fit does not depend on the number of rows."""
    import numpy as np

    k = len(features)
    data = rows.join(folds.select(group, "fold"), group).withColumn("inner", F.pmod(F.xxhash64(group), F.lit(inner)).cast("int"))
    cols = ["fold", "inner", *features, truth]

    def partial(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(["fold", "inner"]):
                z = np.column_stack([np.ones(len(part)), part[features].to_numpy(float), part[truth].to_numpy(float)])
                sums[key] = sums.get(key, 0) + z.T @ z
        yield pd.DataFrame([(int(f), int(i), m.ravel().tolist()) for (f, i), m in sums.items()], columns=["fold", "inner", "moments"])

    size = (k + 2) ** 2
    parts = data.select(*cols).mapInPandas(partial, "fold int, inner int, moments array<double>")
    total = parts.groupBy("fold", "inner").agg(F.array(*[F.sum(F.col("moments")[j]) for j in range(size)]).alias("moments")).collect()  # folds * inner rows
    moments = {(r["fold"], r["inner"]): np.array(r["moments"]).reshape(k + 2, k + 2) for r in total}

    def solve(m: np.ndarray, penalty: float) -> np.ndarray:
        n, mean = m[0, 0], m[0] / m[0, 0]
        c = m - n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(c)[1:-1] / n, 1e-12))
        xx, xy = c[1:-1, 1:-1] / np.outer(sd, sd), c[1:-1, -1] / sd
        w = np.linalg.solve(xx + penalty * np.eye(k), xy) / sd
        return np.concatenate([[mean[-1] - mean[1:-1] @ w], w])

    def loss(m: np.ndarray, w: np.ndarray) -> float:
        v = np.append(w, -1.0)
        return float(v @ m @ v)

    models = []
    for f in sorted({a for a, _ in moments}):
        train = {key: m for key, m in moments.items() if key[0] != f}
        if not train:
            continue
        by_inner = {i: sum(m for (_, j), m in train.items() if j == i) for i in {j for _, j in train}}
        every = sum(by_inner.values())
        scores = [sum(loss(m, solve(every - m, p)) for m in by_inner.values() if (every - m)[0, 0] > k + 1) for p in PENALTIES]
        models.append((f, solve(every, PENALTIES[int(np.argmin(scores))]).tolist()))
    fitted = rows.sparkSession.createDataFrame(models, "fold int, weights array<double>")
    value = F.col("weights")[0]
    for j, name in enumerate(features):
        value = value + F.col("weights")[j + 1] * F.col(name)
    return data.join(F.broadcast(fitted), "fold").withColumn("predicted", value).drop("weights", "inner")


def forest_cross_validation(rows: DataFrame, folds: DataFrame, group: str, features: list[str], truth: str, trees: int = 200, depth: int = 4, leaf: int = 8, seed: int = 0) -> DataFrame:
    """rows with their prediction by a random forest per fold that never saw it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=features, outputCol="x").transform(rows.join(folds.select(group, "fold"), group))
    out = None
    for (f,) in folds.select("fold").distinct().orderBy("fold").collect():
        model = RandomForestRegressor(featuresCol="x", labelCol=truth, predictionCol="predicted", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(data.where(F.col("fold") != f))
        part = model.transform(data.where(F.col("fold") == f)).drop("x")
        out = part if out is None else out.unionByName(part)
    return out


def family_choice(rows: DataFrame, folds: DataFrame, group: str, features: list[str], truth: str, trees: int = 200) -> DataFrame:
    """rows with the prediction of the model family that does better inside each outer fold's training
    groups: ridge or forest, judged by inner folds of those groups alone. One model of each per fold."""
    out = None
    outer = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]  # one row per fold
    for f in outer:
        inner = folds.where(F.col("fold") != f)
        train = rows.join(inner.select(group), group)
        error = {}
        for name, fit in (("ridge", ridge_cross_validation), ("forest", lambda *a: forest_cross_validation(*a, trees=trees))):
            tried = fit(train, inner, group, features, truth)
            error[name] = tried.agg(F.avg(F.abs(F.col(truth) - F.col("predicted")))).first()[0]
        best = min(error, key=lambda n: (error[n], n))
        halves = folds.withColumn("fold", (F.col("fold") == f).cast("int"))
        made = ridge_cross_validation(rows, halves, group, features, truth) if best == "ridge" else forest_cross_validation(rows, halves, group, features, truth, trees=trees)
        part = made.where("fold = 1").withColumn("fold", F.lit(f)).withColumn("family", F.lit(best))
        out = part if out is None else out.unionByName(part)
    return out


def mae_interval(predicted: DataFrame, group: str, truth: str, value: str = "predicted", draws: int = 2000, seed: int = 0) -> DataFrame:
    """Cluster bootstrap over groups of the mean of their mean absolute errors."""
    per = predicted.groupBy(group).agg(F.avg(F.abs(F.col(truth) - F.col(value))).alias("mae")).withColumn("all", F.lit("all"))
    return bootstrap_interval(per, "all", group, "mae", draws=draws, seed=seed).drop("all")


def byte_errors(rows: DataFrame, group: str, original: str, ratio: str, predicted: str) -> DataFrame:
    """Percent error of the predicted compressed bytes: over rows, and the mean of the groups' means."""
    real, made = F.col(original) / F.col(ratio), F.col(original) / F.col(predicted)
    per = rows.withColumn("rel", 100 * F.abs(made - real) / real).groupBy(group).agg(F.sum("rel").alias("rel"), F.count("rel").alias("n"), F.avg("rel").alias("mean"))
    return per.agg((F.sum("rel") / F.sum("n")).alias("byte_mape"), F.avg("mean").alias("mean_group_byte_mape"))

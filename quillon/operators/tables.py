"""Study tables: means by key, feeds of figures, schedules, orders and reports over trials and tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import checks, codec, grids, trials


def mean_by(rows: DataFrame, keys: list[str], value: str, where: Column | None = None) -> DataFrame:
    """Mean of value by keys, over the rows that a condition keeps."""
    return (rows if where is None else rows.where(where)).groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def prefix_split(name: Column, tuning: list[str], mark: str = "-") -> Column:
    """tuning or held_out, by the part of a name before the first mark."""
    return F.when(F.split_part(name, F.lit(mark), F.lit(1)).isin(*tuning), "tuning").otherwise("held_out")


def ratio_of_medians(rows: DataFrame, keys: list[str], predicted: str | None = None) -> DataFrame:
    """Medians of both arms, their ratio and net, and the ratio over a prediction where there is one."""
    more = [] if predicted is None else [F.avg(predicted).alias("predicted")]
    out = rows.groupBy(*keys).agg(F.median("raw_s").alias("raw_median_s"), F.median("compressed_s").alias("compressed_median_s"), *more)
    out = out.withColumn("ratio", F.col("compressed_median_s") / F.nullif(F.col("raw_median_s"), F.lit(0.0))).withColumn("net_s", F.col("raw_median_s") - F.col("compressed_median_s"))
    return out if predicted is None else out.withColumn("measured_over_predicted", F.col("ratio") / F.nullif(F.col("predicted"), F.lit(0.0)))


def median_by(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.median(value).alias("mid"))


def breakdown(samples: DataFrame, keys: list[str], stage: str, seconds: str, nbytes: str, raw_s: str) -> DataFrame:
    """Per stage: its median, share and throughput; per key: the net of the raw median over all stages."""
    mids = samples.groupBy(*keys, stage).agg(F.median(seconds).alias("median_s"), F.max(nbytes).alias("nbytes"), F.median(raw_s).alias("raw_s"))
    w = Window.partitionBy(*keys)
    total = F.sum("median_s").over(w)
    return mids.select(*keys, stage, "median_s", (F.col("median_s") / F.nullif(total, F.lit(0.0))).alias("share"), (F.col("nbytes") / 1e9 / F.nullif(F.col("median_s"), F.lit(0.0))).alias("gbps"), (F.max("raw_s").over(w) - total).alias("net_s"))


def slots(rows: DataFrame, keys: list[str], order: str, depth: int) -> DataFrame:
    """rows with their number, the slot that a ring of `depth` slots gives them, whether they reuse a
    slot, and the marker of every third pass."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("number", number).withColumn("slot", F.col("number") % depth).withColumn("reused", F.col("number") >= depth).withColumn("third", F.col("number") % 3 == 2)


def integer_in(text: Column) -> Column:
    """The first integer in a text, null if there is none."""
    found = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def first_other(rows: DataFrame, keys: list[str], score: str, label: str, skip: str) -> DataFrame:
    """The label of the largest score (ties: first label) that is not `skip`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), label)
    return rows.where(F.col(label) != skip).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def shuffled_cells(cells: DataFrame, keys: list[str], unit: list[str], seed: int) -> DataFrame:
    """cells with their turn inside each process, drawn by an MD5 of seed and cell."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*keys, *unit)]).cast("binary"))
    return cells.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(draw, *unit)) - 1)


def large_small_large(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """The forced order of a reuse test: the largest, the smallest, the largest again (ties: none kept apart)."""
    ends = rows.groupBy(*keys).agg(F.max(size).alias("most"), F.min(size).alias("least"))
    return ends.select(*keys, F.posexplode(F.array("most", "least", "most")).alias("turn", size))


def early_middle_late(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows at 0, n // 2 and n - 1 of each key."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("at", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    return numbered.where((F.col("at") == 0) | (F.col("at") == F.floor(F.col("n") / 2)) | (F.col("at") == F.col("n") - 1))


def views(tensors: DataFrame, layouts: list[str], factors: list[float], configs: DataFrame) -> DataFrame:
    """Tensor x view x factor x config; the last three are small literal tables."""
    spark = tensors.sparkSession
    return tensors.crossJoin(F.broadcast(grids.config_grid(spark, {"view": layouts, "c": factors}))).crossJoin(F.broadcast(configs))


def zip_kinds(rows: DataFrame, keys: list[str], kind: str, value: str) -> DataFrame:
    """key, k, v: both kinds of each key side by side; keys without both are left out."""
    pick = lambda x: F.max(F.when(F.col(kind) == x, F.col(value))).alias(x)
    return rows.groupBy(*keys).agg(pick("k"), pick("v")).where("k IS NOT NULL AND v IS NOT NULL")


def speedups(rows: DataFrame, keys: list[str], arm: str, seconds: str) -> DataFrame:
    """Median per key and arm side by side, and the raw median over the compressed one."""
    wide = rows.groupBy(*keys).pivot(arm, ["raw", "compressed"]).agg(F.median(seconds))
    return wide.withColumn("speedup", F.col("raw") / F.nullif(F.col("compressed"), F.lit(0.0)))


def against_serial(rows: DataFrame, keys: list[str], arm: str, seconds: str, serial: str) -> DataFrame:
    """Median per key and arm, over that of the serial arm of the key, with the control gate."""
    mids = rows.groupBy(*keys, arm).agg(F.median(seconds).alias("median_s"))
    base = mids.where(F.col(arm) == serial).select(*keys, F.col("median_s").alias("serial_s"))
    both = mids.join(base, keys)
    return both.withColumn("ratio", F.col("median_s") / F.nullif(F.col("serial_s"), F.lit(0.0))).withColumn("control", trials.control_gate("median_s", "serial_s"))


def improvement(better: Column, worse: Column) -> Column:
    """Percent by which an error is smaller than another."""
    return 100 * (1 - better / F.nullif(worse, F.lit(0.0)))


def cache_constants(tensors: DataFrame, cache: str) -> DataFrame:
    """Per cache: tensors, raw and compressed bytes, the largest tensor and the largest bound in single precision."""
    return tensors.groupBy(cache).agg(F.count("*").alias("tensors"), F.sum("original_bytes").alias("raw_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"), F.max("numel").alias("max_numel"), F.max(F.col("eps").cast("float")).alias("eps_max"))


def moved_check(rows: DataFrame, cache: str) -> DataFrame:
    """Per cache: tensors that are not byte-exact, the worst error, the largest bound, and whether the
    error is within it and bf16's rounding at the largest magnitude."""
    out = rows.groupBy(cache).agg(F.count("*").alias("tensors"), F.count_if(~F.col("exact")).alias("mismatched"), F.max("err").alias("worst"), F.max("eps").alias("eps_max"), F.max("magnitude").alias("magnitude"))
    return out.withColumn("within", codec.within_rounding(F.col("worst"), F.col("eps_max"), F.col("magnitude"))).drop("magnitude")


def verified(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: byte-exact tensors, failing ones, the worst error over its own bound, and the gate."""
    over = F.col("err") / F.nullif(F.col("eps"), F.lit(0.0))
    counts = rows.groupBy(*keys).agg(F.count_if("exact").alias("byte_exact"), F.max(over).alias("worst_over_eps"))
    return checks.gate(rows.withColumn("ok", F.col("err") <= F.col("eps") + codec.TOLERANCE), "ok", keys).join(counts, keys)


def stage_gate(gates: DataFrame, order: str, passed: str) -> DataFrame:
    """gates with `runs`: a stage runs if all earlier gates passed."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # one row per stage of a protocol
    return gates.withColumn("runs", F.coalesce(F.bool_and(passed).over(w), F.lit(True)))


def protocol(spark: SparkSession, fields: dict) -> DataFrame:
    """A protocol as one document: its fields as JSON, and the SHA-256 that names it."""
    text = F.to_json(F.create_map(*[F.lit(x) for k, v in sorted(fields.items()) for x in (k, str(v))]))
    return spark.range(1).select(text.alias("document")).withColumn("name", F.substring(F.sha2(F.col("document").cast("binary"), 256), 1, 16)).withColumn("frozen_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def ids_hash(ids: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of comma-joined ids."""
    return F.substring(F.sha1(F.array_join(ids.cast("array<string>"), ",").cast("binary")), 1, 16)


def write_sizes(samples: DataFrame, size: str, seconds: str) -> DataFrame:
    """GB/s of the median by write size, and over the best size."""
    out = samples.groupBy(size).agg(F.median(seconds).alias("median_s"), F.count("*").alias("reps")).withColumn("gbps", F.col(size) / 1e9 / F.nullif(F.col("median_s"), F.lit(0.0)))
    best = out.agg(F.max("gbps").alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("of_best", F.col("gbps") / F.col("best")).drop("best")


def volume_control(samples: DataFrame, volume: str, seconds: str) -> DataFrame:
    """Median time of each payload volume over that of the full volume, next to the share of bytes."""
    mids = samples.groupBy(volume).agg(F.median(seconds).alias("median_s"))
    full = mids.agg(F.max_by("median_s", volume).alias("full_s"), F.max(volume).alias("full"))
    return mids.crossJoin(F.broadcast(full)).select(volume, "median_s", (F.col("median_s") / F.col("full_s")).alias("time_share"), (F.col(volume) / F.col("full")).alias("byte_share"))

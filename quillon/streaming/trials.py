"""Streaming aggregates over append-only trial logs.

Counts and sums of logarithms are the whole state, so the running geometric ratio of a stream
equals that of the batch over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trials import geometric_ratio

TRIALS = "segment int, cache string, path string, pair bigint, raw_first boolean, raw_s double, compressed_s double, t_wall double"


def read_trials(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Trial logs as a stream of JSON lines; files_per_batch bounds a micro-batch."""
    return spark.readStream.schema(TRIALS).option("maxFilesPerTrigger", files_per_batch).json(path)


def running_ratio(trials: DataFrame, keys: tuple[str, ...] = ("cache", "path")) -> DataFrame:
    """Pairs and geometric ratio so far per key (complete or update mode)."""
    return trials.groupBy(*keys).agg(F.count("*").alias("pairs"), geometric_ratio("compressed_s", "raw_s").alias("ratio"))


def running_group_bounds(elements: DataFrame, block_size: int) -> DataFrame:
    """Bounds of blockwise groups of a stream of elements: batches need not align with blocks, as the
    state keeps open blocks."""
    group = F.call_function("div", F.col("pos"), F.lit(block_size).cast("bigint"))
    return elements.groupBy("tensor_id", group.alias("group_id")).agg(F.count("*").alias("n"), F.min("value").alias("gmin"), F.max("value").alias("gmax"))


def write_complete(rows: DataFrame, name: str, checkpoint: str):
    """A query that holds the current table in memory under a name; processes what is there and stops."""
    return rows.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

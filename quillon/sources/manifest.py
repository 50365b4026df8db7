"""Nested manifests as JSON, with a version check on read, and their tall form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
SCHEMA = (
    "schema_version int, corpus_id string, "
    "env struct<gpu:string,gpu_count:int,driver:string,cuda:string,torch:string,model_id:string,model_revision:string,weight_dtype:string,image_digest:string,notes:string>, "
    "tensors array<struct<name:string,shape:array<int>,dtype:string,contiguous:boolean,producer:string,consumer:string,family:string,bytes_per_request:bigint,extras:map<string,string>>>"
)
OBSERVATION = (
    "doc string, layer int, kind string, seq_len int, bf16_bytes bigint, std double, mean double, range double, outlier_rate double, near_zero_frac double, "
    "cuszp map<string,struct<eps_abs:double,cmp_bytes:bigint,ratio:double,max_error_fp32:double,max_error_bf16:double,within_eps_fp32:boolean>>"
)


def read_manifest(spark: SparkSession, path: str, version: int = VERSION) -> DataFrame:
    """One row per manifest; reading another version is an error."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    bad = F.concat(F.lit("unsupported manifest version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))
    return rows.where(F.when(F.col("schema_version") == version, F.lit(True)).otherwise(F.raise_error(bad).cast("boolean")))


def write_manifest(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def tensors(manifest: DataFrame) -> DataFrame:
    """One row per tensor."""
    return manifest.select("corpus_id", F.explode("tensors").alias("t")).select("corpus_id", "t.*")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def tall_observations(rows: DataFrame) -> DataFrame:
    """Observations with results and a positive deviation, one row per key c{c}_{mode} of their map, with features."""
    kept = rows.where(F.col("cuszp").isNotNull() & (F.size("cuszp") > 0) & (F.col("std") > 0))
    tall = kept.select("*", F.explode("cuszp").alias("key", "r")).drop("cuszp")
    c = F.regexp_extract("key", r"^c([0-9.eE+-]+?)_", 1).cast("double")
    mode = F.regexp_extract("key", r"_([^_]+)$", 1)
    return tall.select("doc", "layer", "kind", "seq_len", c.alias("c"), mode.alias("mode"), "std", "range", "outlier_rate", "near_zero_frac", "r.*")


def features(tall: DataFrame, layers: int) -> DataFrame:
    """Model features of tall observations."""
    return tall.select(
        "doc", "ratio", (F.col("layer") / F.lit(max(layers - 1, 1))).alias("layer_frac"), (F.col("kind") == "k").cast("int").alias("is_k"),
        F.ln("seq_len").alias("ln_seq"), F.ln("c").alias("ln_c"), F.ln("std").alias("ln_std"), F.ln(F.col("range") / F.col("std")).alias("ln_range_over_std"), "outlier_rate", "near_zero_frac",
    )


def environment(spark: SparkSession) -> DataFrame:
    """What this session runs on, as one row."""
    return spark.range(1).select(F.lit(spark.version).alias("spark"), F.lit(spark.sparkContext.pythonVer).alias("python"), F.lit(spark.sparkContext.master).alias("master"), F.lit(spark.sparkContext.defaultParallelism).alias("parallelism"))


def cost_candidates(rows: DataFrame) -> DataFrame:
    """Rows keyed w{bits}_{shape} with typed bit_width and element count of the shape."""
    return rows.withColumn("bit_width", F.regexp_extract("key", r"^w(\d+)_", 1).cast("int")).withColumn("numel", F.aggregate(F.regexp_extract_all("key", F.lit(r"(\d+)(?=[,)x])"), F.lit(1)), F.lit(1).cast("bigint"), lambda p, x: p * x.cast("bigint")))

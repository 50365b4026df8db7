"""Tensors from folders of files, with what their names say, in a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tensors import file_columns, from_rows

#: Files of a corpus, of a whole cache and of a pilot.
CORPUS, FULL_CACHE, PILOT = "*", "l*_?*", "p*"


def scan(spark: SparkSession, path: str, pattern: str = CORPUS, row: str = "row", values: str = "values") -> DataFrame:
    """file, layer, kind and the rows (row, values) of Parquet files that match the pattern; the name is
    the file's or, for a table written in parts, its folder's. Null layer and kind: the name has none."""
    rows = spark.read.parquet(f"{path}/{pattern}") if pattern != CORPUS else spark.read.parquet(path)
    at = F.col("_metadata.file_path")
    part = F.regexp_extract(at, r"([^/]+)/part-[^/]+$", 1)
    file = F.when(part != "", part).otherwise(F.regexp_extract(at, r"([^/]+)$", 1))
    layer, kind = file_columns(file)
    return rows.select(file.alias("file"), layer.alias("layer"), kind.alias("kind"), F.col(row).cast("bigint").alias("row"), F.col(values).cast("array<float>").alias("values"))


def ordinals(scanned: DataFrame) -> DataFrame:
    """file, ordinal: files in the order of their names. One row per file is ranked."""
    from pyspark.sql import Window

    return scanned.select("file").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("file")) - 1)


def elements(scanned: DataFrame) -> DataFrame:
    """The long form: tensor_id (the file), pos, row_id, channel, value."""
    return from_rows(scanned, F.col("file"), "row", "values")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents, one row per file; text that is none, or lacks all fields, is an error."""
    made = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(made).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    names = [f.name for f in made.fields[:-1]]
    bad = F.col("_corrupt").isNotNull() | F.forall(F.array(*[F.col(n).isNull() for n in names]), lambda x: x)
    first = F.when(bad, F.raise_error(F.lit("not a result document")).cast(made[0].dataType)).otherwise(F.col(names[0]))
    return rows.withColumn(names[0], first).drop("_corrupt")


def write_results(rows: DataFrame, path: str) -> None:
    """A small result table as one JSON file; folders are made."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def candidates_for(costs: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """The rows of a cost table for each payload, by an equi-join on its key."""
    return payloads.join(costs, key)


def dry_run_manifest(spark: SparkSession, corpus_id: str, layers: int, heads: int, tokens: int, width: int, dtype: str = "bf16") -> DataFrame:
    """The manifest that a capture of this shape would write: two tensors a layer, no values."""
    size = {"bf16": 2, "fp16": 2, "fp32": 4}[dtype]
    kinds = F.explode(F.array(F.lit("k"), F.lit("v"))).alias("kind")
    rows = spark.range(layers).select(F.col("id").cast("int").alias("layer"), kinds)
    entry = F.struct(
        F.format_string("l%02d_%s", "layer", "kind").alias("name"), F.array(*map(F.lit, (1, heads, tokens, width))).alias("shape"), F.lit(dtype).alias("dtype"), F.lit(True).alias("contiguous"),
        F.lit("prefill").alias("producer"), F.lit("decode").alias("consumer"), F.lit("kv").alias("family"), F.lit(heads * tokens * width * size).cast("bigint").alias("bytes_per_request"),
    )
    return rows.groupBy().agg(F.array_sort(F.collect_list(entry)).alias("tensors")).select(F.lit(1).alias("schema_version"), F.lit(corpus_id).alias("corpus_id"), "tensors")

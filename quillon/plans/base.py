"""Registration of queries with their checking SQL, and the adapters from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tensors import from_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Width of the rows in `embeddings`.
WIDTH = 64


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one matrix; vec_id is the row."""
    return from_rows(table(spark, sf_dir, "embeddings"), F.lit("emb"), "vec_id", "embedding")


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One matrix per label; rows keep their vec_id."""
    return from_rows(table(spark, sf_dir, "embeddings"), F.col("label").cast("string"), "vec_id", "embedding")


#: The same in SQL.
ELEMENTS = f"el AS (SELECT CAST(label AS VARCHAR) AS label, vec_id AS row_id, c AS channel, vec_id * {WIDTH} + c AS pos, embedding[c + 1] AS v FROM (SELECT *, unnest(range({WIDTH})) AS c FROM embeddings))"


def bf16_sql(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    e = f"greatest(floor(log2(abs({x}))), -126)"
    return f"CASE WHEN {x} = 0 THEN CAST(0 AS FLOAT) ELSE CAST(round_even({x} / pow(2, {e} - 7), 0) * pow(2, {e} - 7) AS FLOAT) END"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as paired trials: raw_s, compressed_s by cache, path, segment."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("cache"), F.col("l_linestatus").alias("path"), F.pmod("l_linenumber", F.lit(3)).alias("segment"), F.col("l_orderkey").alias("pair"), "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_extendedprice").alias("raw_s"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("compressed_s"),
    )


TRIALS = "trials AS (SELECT l_returnflag AS cache, l_linestatus AS path, l_linenumber % 3 AS segment, l_orderkey AS pair, l_linenumber, l_extendedprice AS raw_s, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS compressed_s FROM lineitem)"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """df with columns rounded, so that summation order does not show; -0 becomes 0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})

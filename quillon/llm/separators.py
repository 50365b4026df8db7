"""Token counts from flat, unindexed token files by a scan for the end-of-document id.

A flat file is little-endian ids one after another, two bytes each where the vocabulary allows it,
each document followed by the separator. Here it is a table of consecutive fixed-size blocks (part,
block, payload) that pay no heed to documents. Every block is searched by one vector comparison,
by itself; documents that cross blocks are stitched by a prefix scan over one row per block (ids so
far, documents so far, last separator so far, and the block's separators, 8 bytes a document), first
inside runs of `RUN` blocks and then over the runs, so that one huge file does not become one task.

Defined results: an empty document has 0 ids; ids after the last separator are one more document,
marked as not terminated; an empty file has no documents; a block that is not whole ids is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, slices, small_or_not, table
from .tokens import encoder

BLOCK_IDS = 1 << 19
RUN = 4096
#: One above the ids of word_bpe_49k.json, so that no text can hold it.
SEPARATOR = 49_408
FLAT = "part int, block bigint, payload binary, doc_ids array<bigint>"


def id_type(separator: int) -> np.dtype:
    return np.dtype("<u2") if separator < 1 << 16 else np.dtype("<u4")


def flat_blocks(docs: DataFrame, tokenizer: str, separator: int = SEPARATOR, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """docs encoded into flat blocks, a part per partition. doc_ids names the documents that end in a
    block; the scan does not read it."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(docs.sparkSession)
    schema = T._parse_datatype_string(FLAT)
    arrow, kind = to_arrow_schema(schema), id_type(separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer, separator).encode
        ids, names, ends, block = np.zeros(0, kind), [], np.zeros(0, np.int64), 0

        def made(cut: int) -> pa.RecordBatch:
            nonlocal ids, names, ends, block
            k = int(np.searchsorted(ends, cut, side="right"))
            row = [[part], [block], [ids[:cut].tobytes()], [names[:k]]]
            ids, names, ends, block = ids[cut:], names[k:], ends[k:] - cut, block + 1
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for rows in slices(batch, "text"):
                got, n = encode(rows.column("text").cast(pa.binary()).to_pylist())
                ends = np.concatenate([ends, np.cumsum(n) + len(ids)])
                ids = np.concatenate([ids, got.astype(kind)])
                names += rows.column("doc_id").to_pylist()
                while len(ids) >= block_ids:
                    yield made(block_ids)
        if len(ids):
            yield made(len(ids))

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def flat_files(spark: SparkSession, path: str, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS) -> DataFrame:
    """part, block, payload of raw flat files, numbered by their paths. A file is cut where it is read,
    and only its blocks go on. Spark reads a file as one value, so one above 2 GB is an error; larger
    corpora are several files, or tables of blocks as `flat_blocks` writes them."""
    size = block_ids * id_type(separator).itemsize
    files = spark.read.format("binaryFile").load(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                data = content.as_buffer()
                for k in range(-(-len(data) // size)):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([k], pa.int64()), pa.array([data.slice(k * size, min(size, len(data) - k * size)).to_pybytes()], pa.binary())], names=["path", "block", "payload"])

    part = F.dense_rank().over(Window.orderBy("path")) - 1  # one row per file
    named = files.select(F.col("path").alias("of"), part.cast("int").alias("part"))
    blocks = files.select("path", "content").mapInArrow(cut, "path string, block bigint, payload binary")
    return blocks.join(small_or_not(named, 512), F.col("path") == F.col("of")).select("part", "block", "payload")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """part, ordinal, start, n_tokens, terminated of every document in flat blocks."""
    kind = id_type(separator)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for payload in batch.column("payload"):
                ids = np.frombuffer(payload.as_buffer(), kind)
                n.append(len(ids))
                found.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("block"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["part", "block", "n", "seps"])

    rows = blocks.select("part", "block", "payload").mapInArrow(scan, "part int, block bigint, n bigint, seps array<bigint>")
    rows = rows.withColumn("run", F.floor(F.col("block") / RUN)).withColumn("docs", F.size("seps").cast("bigint"))
    inside = Window.partitionBy("part", "run").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ids0", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("docs0", F.coalesce(F.sum("docs").over(before), F.lit(0)))
    rows = rows.withColumn("last", F.col("ids0") + F.element_at(F.when(F.col("docs") > 0, F.col("seps")), -1)).withColumn("last0", F.max("last").over(before))
    # one row per run of blocks
    runs = rows.groupBy("part", "run").agg(F.sum("n").alias("run_ids"), F.sum("docs").alias("run_docs"), F.max("last").alias("run_last"))
    earlier = Window.partitionBy("part").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("ids1", F.coalesce(F.sum("run_ids").over(earlier), F.lit(0))).withColumn("docs1", F.coalesce(F.sum("run_docs").over(earlier), F.lit(0)))
    runs = runs.withColumn("last1", F.max(F.col("ids1") + F.col("run_last")).over(earlier))
    ends = Window.partitionBy("part")
    runs = runs.withColumn("part_runs", F.max("run").over(ends))
    full = rows.join(runs.select("part", "run", "ids1", "docs1", "last1", "part_runs"), ["part", "run"])
    full = full.select("part", "seps", "n", (F.col("ids0") + F.col("ids1")).alias("base"), (F.col("docs0") + F.col("docs1")).alias("first"), F.coalesce(F.col("ids1") + F.col("last0"), F.col("last1"), F.lit(-1)).alias("carry"))
    doc = full.select("part", "base", "first", "carry", "seps", F.posexplode("seps").alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("carry") + 1).otherwise(F.col("base") + F.get("seps", F.col("k") - 1) + 1)
    whole = doc.select("part", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("at") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = runs.groupBy("part").agg(F.sum("run_ids").alias("ids"), F.sum("run_docs").alias("ordinal"), F.coalesce(F.max(F.col("ids1") + F.col("run_last")), F.lit(-1)).alias("last")).where("ids > last + 1")
    return whole.union(tail.select("part", "ordinal", F.col("last") + 1, F.col("ids") - F.col("last") - 1, F.lit(False)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, part, ordinal, start, n_tokens of all documents, from flat files of their ids."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    flat_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).write.parquet(path)
    flat = spark.read.schema(FLAT).parquet(path)
    counts = count_tokens(flat)
    named = flat.select("part", "block", F.size("doc_ids").cast("bigint").alias("n"), "doc_ids")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = named.select("part", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ids = named.join(base, ["part", "block"]).select("part", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("part", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return counts.join(ids, ["part", "ordinal"]).select("doc_id", "part", "ordinal", "start", "n_tokens")

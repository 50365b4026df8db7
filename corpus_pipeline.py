"""The corpus pipeline: documents through five of the operators, each stage written and read again.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> mixing -> token output

All stages but the last return the columns of documents; the last returns, per document of the
token file, doc_id, start, n_tokens and ids_crc32 as read back from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, jaccard, mix, quality, tokens
from quillon.llm.common import stage, table

#: Near-duplicates share 80 % of their five-word shingles.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return jaccard.keep_one(docs, SHINGLE_WORDS, *SIMILARITY)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, dealt among shards and shuffled."""
    return mix.mix(docs).select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file's documents, as read back."""
    return tokens.documents_digest(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_ids),
]

#: SQL cannot express the classifier or the draw; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)

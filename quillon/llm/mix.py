"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Words are counted once per document; sizes are summed per source (one row per source).
2. Targets: the sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the
   words of all; a target stops at three times its source, the excess is shared again by weight.
3. Each source is cut into blocks by a keyed hash of its documents and the blocks are permuted.
   A target of r times the source takes every block floor(r) times, once more the permuted blocks
   that still fit, and of the smallest block left over as many documents as come nearest.
4. The block draws of all sources are dealt among output shards by a binary tree: each node splits
   its exact quotas with one multivariate-hypergeometric draw, so every shard holds the mix.
5. Each shard takes disjoint runs of the permuted draws and shuffles its rows locally.

Only tables with a proven bound reach the driver or are broadcast: one row per source
(`MAX_SOURCES`, more raise an error) and one per block (`MAX_BLOCKS` + sources). Randomness comes
from hashes and from generators seeded by the tree node, so reruns agree.

Defined results: a null text has no words; documents without words are drawn with their block
like any other; repeated rows share a hash and so are drawn alike; null doc_ids hash their text;
a source without words has target 0 and is not taken; an empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, bounded_batches, release_memory, slices, stage, table, text_bytes, tidy, unstage, words

MAX_REPEATS = 3
MAX_SOURCES = 100_000
MIN_SHARDS, MAX_SHARDS, SHARD_WORDS = 16, 1 << 16, 1 << 26
BLOCKS_PER_SHARD, MAX_BLOCKS = 256, 1 << 20
SEED = 20240917


def source_targets(sizes: list[tuple[str | None, int]]) -> list[tuple[str | None, int, float]]:
    """(source, words, target) in code-point order, null last."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weights = [1 + i % 3 for i in range(len(order))]
    targets: dict[int, float] = {}
    left = float(sum(n for _, n in order))
    while True:
        free = [i for i in range(len(order)) if i not in targets]
        total = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / total > MAX_REPEATS * order[i][1]]
        if not above:
            targets |= {i: left * weights[i] / total for i in free}
            return [(s, n, targets[i]) for i, (s, n) in enumerate(order)]
        for i in above:
            targets[i] = float(MAX_REPEATS * order[i][1])
            left -= targets[i]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws per (shard, source): the leaves of the splitting tree; columns sum to quotas exactly."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def descend(lo: int, hi: int, left: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid = (lo + hi) // 2
        n = int(round(int(left.sum()) * (mid - lo) / (hi - lo)))
        drawn = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(left, n, method="marginals") if n else np.zeros_like(left)
        descend(lo, mid, drawn)
        descend(mid, hi, left - drawn)

    descend(0, shards, np.asarray(quotas, np.int64))
    return out


@dataclass
class MixPlan:
    sources: DataFrame  # name, idx, words, target, n_blocks
    blocks: DataFrame  # idx, block, shards (of whole draws), part_shard and part_cut (of the cut draw)
    seed: int
    shards: int


def _rank(docs: DataFrame, doc_id: str, text: str, seed: int):
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.col(text)))


def _order(rank, seed: int):
    return F.xxhash64(F.lit(seed + 1), rank)


def count_words(docs: DataFrame, text: str, size: str) -> DataFrame:
    """docs with the text replaced by its number of words."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(size, T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = text_bytes(part.column(text))
                _, _, row = words(data, offsets, SPACED)
                n = np.bincount(row, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n, pa.int64())], schema=arrow)

    return docs.mapInArrow(tidy(run), schema)


def plan_mix(sized: DataFrame, seed: int = SEED, shards: int | None = None) -> MixPlan:
    """sized: source, rank, size. Three small aggregations; see the module's text."""
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    docs_of = {r["source"]: r["docs"] for r in per}
    targets = source_targets([(r["source"], r["words"]) for r in per])
    total = sum(n for _, n, _ in targets)
    shards = shards or int(min(MAX_SHARDS, max(MIN_SHARDS, -(-total // SHARD_WORDS))))
    all_blocks = min(MAX_BLOCKS, shards * BLOCKS_PER_SHARD)
    n_blocks = [max(1, min(docs_of[s], round(all_blocks * n / max(total, 1)))) for s, n, _ in targets]
    sources = spark.createDataFrame(
        pa.table({"name": pa.array([s for s, _, _ in targets], pa.string()), "idx": pa.array(range(len(targets)), pa.int32()), "words": pa.array([n for _, n, _ in targets], pa.int64()), "target": pa.array([t for _, _, t in targets], pa.float64()), "n_blocks": pa.array(n_blocks, pa.int64())})
    )
    placed = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["name"])).select("idx", F.pmod("rank", "n_blocks").alias("block"), "rank", "size")
    words_of = [np.zeros(n, np.int64) for n in n_blocks]
    for r in placed.groupBy("idx", "block").agg(F.sum("size").alias("n")).collect():
        words_of[r["idx"]][r["block"]] = r["n"]

    whole: list[list[list[int]]] = []  # by source and block: shards
    draws: list[list[tuple[int, bool]]] = []  # by source, permuted: (block, whole)
    edges: list[tuple[int, int, float]] = []  # (idx, block, words still to take)
    for i, (_, n, target) in enumerate(targets):
        rng = np.random.default_rng([seed, i])
        order = rng.permutation(n_blocks[i])
        times = int(min(MAX_REPEATS, target // n)) if n else 0
        rest = target - times * n if n else 0.0
        mine = [(int(b), True) for b in order.tolist() * times]
        spare = []  # blocks that do not fit; those after them that do are still drawn
        for b in order.tolist() if rest > 0 else ():
            if words_of[i][b] <= rest:
                mine.append((b, True))
                rest -= float(words_of[i][b])
            else:
                spare.append(b)
        if rest > 0 and spare:
            smallest = min(spare, key=lambda b: words_of[i][b])
            edges.append((i, smallest, rest))
            mine.append((smallest, False))
        draws.append([mine[k] for k in rng.permutation(len(mine))])
        whole.append([[] for _ in range(n_blocks[i])])
    quotas = np.array([len(d) for d in draws], np.int64)
    dealt = split_quotas(quotas, shards, seed) if len(quotas) else np.zeros((shards, 0), np.int64)
    part: dict[tuple[int, int], int] = {}
    for i, mine in enumerate(draws):
        for (block, is_whole), shard in zip(mine, np.repeat(np.arange(shards), dealt[:, i]).tolist()):
            if is_whole:
                whole[i][block].append(shard)
            else:
                part[i, block] = shard

    cuts: dict[int, int] = {}
    if edges:
        edge = spark.createDataFrame(pa.table({"idx": pa.array([e[0] for e in edges], pa.int32()), "block": pa.array([e[1] for e in edges], pa.int64()), "rest": pa.array([e[2] for e in edges], pa.float64())}))
        w = Window.partitionBy("idx").orderBy("at")
        taken = (
            placed.join(F.broadcast(edge), ["idx", "block"])
            .groupBy("idx", "rest", _order(F.col("rank"), seed).alias("at"))
            .agg(F.sum("size").alias("n"))
            .withColumn("upto", F.sum("n").over(w))
            .where(F.col("upto") - F.col("n") / 2 <= F.col("rest"))
        )
        cuts = {r["idx"]: r["cut"] for r in taken.groupBy("idx").agg(F.max("at").alias("cut")).collect()}
    keys = [(i, b) for i in range(len(targets)) for b in range(n_blocks[i])]
    blocks = spark.createDataFrame(
        pa.table(
            {
                "b_idx": pa.array([i for i, _ in keys], pa.int32()),
                "b_block": pa.array([b for _, b in keys], pa.int64()),
                "shards": pa.array([whole[i][b] for i, b in keys], pa.list_(pa.int32())),
                "part_shard": pa.array([part.get(k) for k in keys], pa.int32()),
                "part_cut": pa.array([cuts.get(k[0]) if k in part else None for k in keys], pa.int64()),
            }
        )
    )
    del keys, words_of, whole, draws, part
    release_memory()
    return MixPlan(sources, blocks, seed, shards)


def apply_plan(rows: DataFrame, plan: MixPlan, source: str, rank) -> DataFrame:
    """mix_row (a struct of the columns of rows), mix_rank, mix_words and mix_target of the row's source
    and mix_shards: a shard for each time taken. No column of rows can clash, as all are in mix_row."""
    s, b = plan.sources, plan.blocks
    out = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("mix_row"), F.col(f"`{source}`").alias("mix_source"), rank.alias("mix_rank"))
    out = out.join(F.broadcast(s), out["mix_source"].eqNullSafe(s["name"]), "left")
    out = out.join(F.broadcast(b), (out["idx"] == b["b_idx"]) & (F.pmod(out["mix_rank"], out["n_blocks"]) == b["b_block"]), "left")
    part = F.when(_order(F.col("mix_rank"), plan.seed) <= F.col("part_cut"), F.array("part_shard")).otherwise(F.array().cast("array<int>"))
    return out.select("mix_row", "mix_rank", F.col("words").alias("mix_words"), F.col("target").alias("mix_target"), F.concat("shards", part).alias("mix_shards"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED, shards: int | None = None) -> DataFrame:
    """The mix itself: docs' columns and `mix_shard` (a clashing column is replaced), each row as often
    as it is taken, every shard in a partition and order of its own."""
    docs = docs.drop("mix_shard")
    rank = _rank(docs, doc_id, text, seed)
    sized = stage(count_words(docs.select(F.col(f"`{source}`").alias("source"), rank.alias("rank"), F.col(f"`{text}`").alias("text")), "text", "size"), "mix")
    plan = plan_mix(sized, seed, shards)
    found = apply_plan(docs, plan, source, rank)
    rows = found.select("mix_row", "mix_rank", F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    within = F.xxhash64(F.lit(seed + 2), F.col("mix_shard"), F.col("mix_copy"), F.col("mix_rank"))
    dealt = rows.repartitionById(plan.shards, "mix_shard").sortWithinPartitions("mix_shard", within)
    unstage(sized)
    return dealt.select(*[F.col("mix_row").getField(c).alias(c) for c in docs.columns], "mix_shard")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rank = _rank(docs, "doc_id", "text", SEED)
    sized = stage(count_words(docs.withColumn("rank", rank), "text", "size"), "mix")
    found = apply_plan(sized, plan_mix(sized), "source", F.col("rank"))
    size = F.col("mix_row.size")
    return found.select("mix_row.doc_id", size.alias("size"), F.col("mix_words").alias("source_size"), F.col("mix_target").alias("target"), (size * F.size("mix_shards")).alias("taken"), F.array_sort("mix_shards").alias("shards"))

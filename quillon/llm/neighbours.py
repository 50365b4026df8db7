"""Approximate nearest neighbours with balanced posting lists.

1. Centroids: a bounded sample (`SAMPLE` vectors with the smallest hashes) is halved at medians into
   equal leaves, in an order in which near leaves are near. Rounds of k-means refine their means
   with a price on each list that grows while it holds more than its share, so that lists stay
   balanced; the prices hold for all rows as well. Equal centroids are merged.
2. A graph over the centroids (nearest ones, their reverse edges and some random long edges) is kept
   in memory by every worker; beam search on it finds the centroids near a vector, with a wider
   beam wherever the first was too narrow.
3. Every vector goes to its nearest list; one near a boundary is replicated to further lists, up to
   `REPLICAS`, if they are within `CLOSURE` of the nearest distance and no list already taken is
   nearer to that centroid than `SPREAD` times the vector's distance.
4. Distance-ratio pruning: a query takes the lists whose centroid is within a ratio of its nearest
   centroid's distance, and more, if these hold too few vectors to fill its answer. The ratio is the
   smallest at which `RECALL` of the neighbours inside the sample are in a list that is taken. Where vectors form clusters
   that is a few lists; among vectors without any structure it can be half of them.
5. Lists are packed in their order into bins of about `BIN_ROWS` vectors; a list beyond that is dealt among
   bins of its own. A bin compares each query that takes lists of it with these lists by one matrix
   product, scores what may be among the best k exactly in double precision, and returns the best
   k of each query; more than `BIN_QUERIES` queries are dealt into turns.
6. A query that got fewer than k while there are more candidates is asked again over all lists.

Equal vectors are one entry of the index with its k + 1 smallest ids, which is all that an answer
of k can show; the entry limit is applied before the shuffle as well. There are at most `MAX_LISTS`
lists; beyond `MAX_LISTS * LIST_ROWS` vectors lists hold more each.

Defined results: null, empty and zero vectors and those with a null or non-finite component take
no part, nor do null ids, nor vectors of another length than the most frequent one (ties: the
longest). Of a repeated query id the smallest vector asks; of a repeated candidate id the nearest
row answers, and rows with the query's own id never do. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, unstage

SAMPLE = 32_768
LIST_ROWS, MAX_LISTS = 256, 8192
REPLICAS, CLOSURE, SPREAD = 4, 0.1, 0.5
RECALL, TRIED, MOST_RATIO = 0.97, 512, 4.0
BEAM = 48
BALANCE, ROUNDS = 0.3, 4
DEGREE, LONG_EDGES, ENTRIES = 16, 4, 16
BIN_ROWS, BIN_QUERIES, CELLS = 1 << 14, 4096, 1 << 21
SEED = 5


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by the expanded form; only for choosing lists and candidates."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def _halves(x: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    a, b = x[rng.choice(at, 2, replace=False)]
    for _ in range(4):
        side = _distances(x[at], np.stack([a, b])).argmin(1)
        if 0 < side.sum() < len(at):
            a, b = x[at[side == 0]].mean(0), x[at[side == 1]].mean(0)
    order = at[np.argsort(x[at] @ (b - a), kind="stable")]
    return order[: len(at) // 2], order[len(at) // 2 :]


def balanced_centroids(x: np.ndarray, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, prices): a row's list is the one with the least squared distance plus price."""
    rng = np.random.default_rng(seed)
    leaves = [np.arange(len(x))]
    while len(leaves) < k and max(map(len, leaves)) > 1:
        size, missing, grown = max(map(len, leaves)), k - len(leaves), []
        for at in leaves:
            if len(at) > 1 and 2 * len(at) > size and missing > 0:
                grown += _halves(x, at, rng)
                missing -= 1
            else:
                grown.append(at)
        leaves = grown
    c = np.stack([x[at].mean(0) for at in leaves])
    _, first = np.unique(c, axis=0, return_index=True)
    c = c[np.sort(first)]
    price = np.zeros(len(c))
    for _ in range(ROUNDS):
        near, spread = np.empty(len(x), np.int64), 0.0
        for i in range(0, len(x), 1024):
            cost = _distances(x[i : i + 1024], c)
            near[i : i + 1024] = (cost + price).argmin(1)
            spread += float(cost.min(1).sum())
        n = np.bincount(near, minlength=len(c))
        price = np.maximum(0, price + BALANCE * spread / len(x) * np.clip(n * len(c) / len(x) - 1, -1, 1) / 2)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    _, first = np.unique(c, axis=0, return_index=True)
    return c[np.sort(first)], price[np.sort(first)]


class CentroidGraph:
    """Centroids with the edges of a small navigable graph; searched in batches."""

    def __init__(self, centroids: np.ndarray, price: np.ndarray | None = None, seed: int = SEED):
        self.c = centroids.astype(np.float32)
        self.price = np.zeros(len(self.c)) if price is None else price
        k, rng = len(self.c), np.random.default_rng(seed)
        links: list[set[int]] = [set() for _ in range(k)]
        for i in range(0, k, 512):
            near = np.argsort(_distances(self.c[i : i + 512], self.c), axis=1, kind="stable")[:, : DEGREE + 1]
            for j, row in enumerate(near.tolist()):
                for n in row:
                    if n != i + j:
                        links[i + j].add(n)
                        links[n].add(i + j)
        for i in range(k):
            links[i].update(n for n in rng.integers(0, k, LONG_EDGES).tolist() if n != i)
        width = max(1, max(map(len, links)))
        self.edges = np.tile(np.arange(k)[:, None], (1, width))
        for i, x in enumerate(links):
            self.edges[i, : len(x)] = sorted(x)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, ENTRIES)).astype(int))

    def search(self, q: np.ndarray, beam: int = BEAM, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of up to `beam` centroids near each query, nearest first; id -1: none."""
        n, k = len(q), len(self.c)
        beam, rows = min(beam, k), np.arange(len(q))[:, None]
        seen = np.zeros((n, k), bool)
        ids = np.tile(self.entries, (n, 1))
        seen[rows, ids] = True
        d = np.sqrt(_distances(q, self.c[self.entries]))
        done = np.zeros(ids.shape, bool)
        while True:
            if ids.shape[1] > beam:
                keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                ids, d, done = ids[rows, keep], d[rows, keep], done[rows, keep]
            open_d = np.where(done, np.inf, d)
            pick = np.argpartition(open_d, min(width, ids.shape[1]) - 1, axis=1)[:, :width]
            live = np.isfinite(open_d[rows, pick])
            if not live.any():
                break
            done[rows, pick] = True
            new = np.where(live[:, :, None], self.edges[np.maximum(ids[rows, pick], 0)], -1).reshape(n, -1)
            new = np.sort(new, axis=1)
            fresh = new >= 0
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            fresh &= ~seen[rows, np.maximum(new, 0)]
            r, at = np.nonzero(fresh)
            got = new[r, at]
            seen[r, got] = True
            far = np.full(new.shape, np.inf)
            far[r, at] = np.sqrt(((q[r] - self.c[got]) ** 2).sum(1))
            ids = np.concatenate([ids, np.where(fresh, new, -1)], axis=1)
            d = np.concatenate([d, far], axis=1)
            done = np.concatenate([done, ~fresh], axis=1)
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        d = d[rows, order]
        return np.where(np.isfinite(d), ids[rows, order], -1), d


    def lists_of(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, their lists, is it their nearest) for the nearest list and each replica."""
        ids, d = self.search(x.astype(np.float32), beam=2 * DEGREE)
        cost = np.where(ids >= 0, d * d + self.price[np.maximum(ids, 0)], np.inf)
        order = np.argsort(cost, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        take, chosen = [(np.arange(len(x)), ids[:, 0], True)], [ids[:, 0]]
        near = d.min(axis=1)
        for j in range(1, ids.shape[1]):
            ok = (ids[:, j] >= 0) & (d[:, j] <= (1 + CLOSURE) * near) & (sum((c >= 0).astype(int) for c in chosen) < REPLICAS)
            for c in chosen:
                gap = np.sqrt(((self.c[np.maximum(c, 0)] - self.c[np.maximum(ids[:, j], 0)]) ** 2).sum(1))
                ok &= (c < 0) | (gap > SPREAD * d[:, j])
            if ok.any():
                take.append((np.flatnonzero(ok), ids[ok, j], False))
                chosen.append(np.where(ok, ids[:, j], -1))
        return take

    def within(self, x: np.ndarray, ratio: float, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all centroids found within ratio of the nearest distance, and of the next
        ones until they hold `least` vectors."""
        rows, lists, left, beam = [], [], np.arange(len(x)), BEAM
        while len(left):
            ids, d = self.search(x[left].astype(np.float32), beam=beam)
            held = np.cumsum(np.where(ids >= 0, counts[np.maximum(ids, 0)], 0), axis=1)
            short = np.concatenate([np.full((len(left), 1), True), held[:, :-1] < least], axis=1)
            use = (ids >= 0) & ((d <= ratio * d[:, :1]) | short)
            done = ~use[:, -1] | (beam >= len(self.c))
            which, at = np.nonzero(use[done])
            rows.append(left[done][which])
            lists.append(ids[done][which, at])
            left, beam = left[~done], 2 * beam
        return np.concatenate(rows), np.concatenate(lists)


def fitted_ratio(x: np.ndarray, graph: CentroidGraph, k: int, recall: float = RECALL) -> float:
    """The ratio at which `recall` of the k nearest neighbours inside the sample x are in a list taken."""
    tried = np.linspace(0, len(x) - 1, min(len(x), TRIED)).astype(int)
    d = _distances(x[tried], x)
    d[np.arange(len(tried)), tried] = np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    to = np.sqrt(_distances(x[tried], graph.c.astype(np.float64)))
    needed = np.full(len(x), -1)
    needed[np.unique(near)] = np.arange(len(np.unique(near)))
    best = np.full(near.shape, np.inf)
    for rows, lists, _ in graph.lists_of(x[np.unique(near)]):
        at = np.full(len(np.unique(near)), -1)
        at[rows] = lists
        mine = at[needed[near]]
        found = np.take_along_axis(to, np.maximum(mine, 0), 1)
        best = np.minimum(best, np.where(mine >= 0, found, np.inf))
    ratio = best / np.maximum(to.min(axis=1, keepdims=True), 1e-12)
    return float(np.clip(np.quantile(ratio, recall), 1.0, MOST_RATIO))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, embedding: the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    top = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("embedding") == F.lit(top["dim"] if top else 0))


def _assign(rows: DataFrame, shared) -> DataFrame:
    """list, nearest (is it the nearest list), vec_id, embedding: each row in its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                take = graph.lists_of(_matrix(part.column("embedding")))
                which, lists = np.concatenate([w for w, _, _ in take]), np.concatenate([c for _, c, _ in take])
                near = np.concatenate([np.full(len(w), f) for w, _, f in take])
                kept = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(near), kept.column("vec_id"), kept.column("embedding")], names=["list", "nearest", "vec_id", "embedding"])

    return rows.mapInArrow(run, "list int, nearest boolean, vec_id bigint, embedding array<double>")


def pack_lists(sizes: np.ndarray, most: int = BIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, number of bins) of each list: neighbours in order share a bin, large lists have several."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    bin_, held = 0, 0
    for i, (n, p) in enumerate(zip(sizes.tolist(), parts.tolist())):
        if held and held + n > most:
            bin_, held = bin_ + 1, 0
        first[i], held = bin_, held + n
        if p > 1:
            bin_, held = bin_ + p, 0
    return first, parts


def _probe(queries: DataFrame, shared, placed, ratio: float, k: int) -> DataFrame:
    """bin, query_id, query, lists: each query in each bin that holds lists it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, (counts, first, parts) = shared.value, placed.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, lists = graph.within(_matrix(part.column("embedding")), ratio, counts, k + 1)
                times = parts[lists]
                row, lists, bins = np.repeat(row, times), np.repeat(lists, times), np.repeat(first[lists], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((lists, bins, row))
                row, lists, bins = row[order], lists[order], bins[order]
                starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (bins[1:] != bins[:-1])))
                kept = part.take(pa.array(row[starts]))
                taken = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(lists.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(bins[starts]), kept.column("vec_id"), kept.column("embedding"), taken], names=["bin", "query_id", "query", "lists"])

    return queries.mapInArrow(run, "bin bigint, query_id bigint, query array<double>, lists array<int>")


def best_of_bin(postings: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """query_id, vec_id, score: the k nearest of each query in the lists it takes of one bin."""
    none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not postings.num_rows or not asked.num_rows:
        return none
    ids, of = postings.column("vec_id").to_numpy(), postings.column("list").to_numpy()
    order = np.lexsort((ids, of))
    ids, of, x = ids[order], of[order], _matrix(postings.column("embedding"))[order]
    q, names = _matrix(asked.column("query")), asked.column("query_id").to_numpy()
    takes = asked.column("lists").combine_chunks()
    lists, who = takes.flatten().to_numpy(), np.repeat(np.arange(len(takes)), takes.value_lengths().to_numpy())
    by_list = np.argsort(lists, kind="stable")
    lists, who = lists[by_list], who[by_list]
    xx, qq = (x * x).sum(1), (q * q).sum(1)
    rows, places = [], []
    for at in np.unique(of):
        a, b = np.searchsorted(of, at), np.searchsorted(of, at, side="right")
        mine = who[np.searchsorted(lists, at) : np.searchsorted(lists, at, side="right")]
        new = np.append(True, ids[a + 1 : b] != ids[a : b - 1])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        for i in range(0, len(mine), max(1, CELLS // (b - a))):
            some = mine[i : i + max(1, CELLS // (b - a))]
            d = qq[some][:, None] - 2 * q[some] @ x[a:b].T + xx[a:b]
            d[names[some][:, None] == ids[a:b]] = np.inf
            least = np.minimum.reduceat(d, starts, axis=1) if len(starts) < b - a else d
            kth = np.partition(least, min(k, least.shape[1]) - 1, axis=1)[:, min(k, least.shape[1]) - 1]
            near = (least <= (kth + 1e-9 * (qq[some] + xx[a:b].max()))[:, None]) & np.isfinite(least)
            r, c = np.nonzero(near[:, group] if len(starts) < b - a else near)
            rows.append(some[r])
            places.append(a + c)
    row, place = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, places))
    score = np.empty(len(row))
    for i in range(0, len(row), 1 << 15):
        score[i : i + (1 << 15)] = np.sqrt(((x[place[i : i + (1 << 15)]] - q[row[i : i + (1 << 15)]]) ** 2).sum(axis=1))
    order = np.lexsort((score, ids[place], row))
    row, place, score = row[order], place[order], score[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (ids[place][1:] != ids[place][:-1])
    row, place, score = row[once], place[once], score[once]
    order = np.lexsort((ids[place], score, row))
    row, place, score = row[order], place[order], score[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.table({"query_id": names[row[best]], "vec_id": ids[place[best]], "score": score[best]})


def _answers(postings: DataFrame, queries: DataFrame, shared, layout, ratio: float, k: int) -> DataFrame:
    """query_id, vec_id, score: the nearest of each bin, each candidate once."""
    spark = postings.sparkSession
    counts, first, parts = layout
    asked = stage(_probe(queries, shared, spark.sparkContext.broadcast(layout), ratio, k), "ann-asked")
    turns = np.ones(int((first + parts).max()), np.int64)
    for r in asked.groupBy("bin").count().where(F.col("count") > BIN_QUERIES).collect():  # a row for each bin at most
        turns[r["bin"]] = -(-r["count"] // BIN_QUERIES)
    lists = spark.createDataFrame(pa.table({"list": pa.array(range(len(first)), pa.int32()), "first": first, "parts": parts}))
    bins = spark.createDataFrame(pa.table({"bin": pa.array(range(len(turns)), pa.int64()), "turns": turns}))
    dealt = postings.join(F.broadcast(lists), "list").withColumn("bin", F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).join(F.broadcast(bins), "bin")
    dealt = dealt.select("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1)).alias("turn"), "list", "vec_id", "embedding")
    turned = asked.join(F.broadcast(bins), "bin").select("bin", F.pmod(F.xxhash64("query_id"), "turns").alias("turn"), "query_id", "query", "lists")
    found = dealt.groupBy("bin", "turn").cogroup(turned.groupBy("bin", "turn")).applyInArrow(lambda x, y: best_of_bin(x, y, k), "query_id bigint, vec_id bigint, score double")
    out = stage(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "ann-found")
    unstage(asked)
    return out


def nearest(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, vec_id, embedding), "ann-rows")
    same = Window.partitionBy("embedding").orderBy("vec_id")
    entries = rows.withColumn("copy", F.dense_rank().over(same)).where(F.col("copy") <= k + 1).drop("copy").dropDuplicates(["embedding", "vec_id"])
    entries = stage(entries, "ann-entries")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    place = F.xxhash64(F.lit(SEED), "vec_id", "embedding")
    share = min(1.0, 1.2 * SAMPLE / total)  # a few more than needed pass, so that the order below is over few rows
    drawn = entries.where(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))) if total > SAMPLE else entries
    sample = drawn.orderBy(place).limit(SAMPLE)
    fit = _matrix(sample.select("embedding").toArrow().column("embedding"))
    graph = CentroidGraph(*balanced_centroids(fit, int(min(MAX_LISTS, len(fit), -(-total // LIST_ROWS)))))
    ratio = fitted_ratio(fit, graph, k)
    shared = spark.sparkContext.broadcast(graph)

    postings = stage(_assign(entries, shared), "ann-lists")
    own, full = np.zeros(len(graph.c), np.int64), np.zeros(len(graph.c), np.int64)
    for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("nearest"), F.col("vec_id"))).alias("own")).collect():  # at most MAX_LISTS rows
        own[r["list"]], full[r["list"]] = r["own"], r["n"]
    layout = (own, *pack_lists(full))
    queries = stage(rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    found = _answers(postings, queries, shared, layout, ratio, k)
    ids = entries.select("vec_id").distinct().limit(k + 1).count()
    got = found.groupBy("query_id").count().where(F.col("count") >= min(k, ids - 1))
    short = queries.join(got.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if ids > 1 and short.take(1):
        found = found.unionByName(_answers(postings, short, shared, layout, float("inf"), k)).distinct()
    unstage(rows, entries, postings, queries)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0)

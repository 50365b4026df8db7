"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network in numpy.

* Words `[^\\x20\\x09-\\x0D]+` are hashed into `SLOTS` slots, and so is each word's shape (letters
  to a or A, digits to 0, runs shortened), which stands beside it as a second word.
* Random indexing: each slot has a sparse random index vector; its context vector is the sum of
  the index vectors of the words within `REACH` places, over all documents, labelled or not.
* A document is the mean of the index vectors and of the context vectors of its words and shapes,
  plus the norms of these means (repetition shows in them) and its number of words on a log scale.
* The network is trained with Adam on at most `TRAIN_ROWS` labelled rows (the smallest hashes of
  their ids, so the bound does not depend on the input); a fifth of them sets the temperature.

Only the context table (slots x dimension) and the training vectors (rows x dimension), both of a
fixed size, reach the driver. The context table is one pass over the whole texts that shuffles one
row per task and slot, scoring is another without a shuffle.

Defined results: null texts are empty texts and are scored as such; rows with a null id are never
trained on and are not held out; repeated labels of a document are averaged; without rows of both
labels the score is the smoothed share of label 1. Other columns are kept or, if clashing, replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, U64, bounded_batches, mix64, release_memory, slices, stage, table, text_bytes, tidy, unstage, word_hashes, words
from .training import bounded_sample, crc_fold, fit_temperature, row_sums, softmax

SLOTS = 1 << 15
DIM = 48
REACH = 2
HIDDEN = 32
TRAIN_ROWS = 12_000
TRAIN_TASKS = 8
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
SEED = 7
#: Words whose contexts are summed at once, and words after which a task hands its sums on; a word adds
#: at most 16 to a sum, so sums fit 32 bits.
CONTEXT_WORDS, FLUSH_WORDS = 1 << 19, 1 << 26

#: Shape of a byte: a letter's case, a digit, or the byte itself.
_SHAPE = np.array([97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def index_vectors(slots: int = SLOTS, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """Ternary index vectors: four places of each are +1 or -1."""
    out = np.zeros((slots, dim), np.float32)
    for place, sign in zip(*index_places(slots, dim, seed)):
        out[np.arange(slots), place] += sign
    return out


def token_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each word, slot of its shape, row)."""
    s, e, row = words(data, offsets, SPACED)
    shapes = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shapes[1:] != shapes[:-1]
    keep[s] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    h = word_hashes(data, s, e)
    g = mix64(word_hashes(shapes[keep], upto[s], upto[e]) + U64(1))
    return (h >> U64(20)).astype(np.int64) % SLOTS, (g >> U64(20)).astype(np.int64) % SLOTS, row


def index_places(slots: int = SLOTS, dim: int = DIM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the four entries that add up to each index vector."""
    rng = np.random.default_rng(seed)
    drawn = [(rng.integers(0, dim, slots), rng.choice(np.array([-1, 1], np.float32), slots)) for _ in range(4)]
    return np.stack([p for p, _ in drawn]), np.stack([s for _, s in drawn])


def context_sums(slots: np.ndarray, row: np.ndarray, entries: tuple[np.ndarray, np.ndarray], out: np.ndarray) -> None:
    """Adds to out[slot] the index vectors of the words within REACH places in the same row, entry by entry."""
    flat, dim = out.reshape(-1), out.shape[1]
    for d in range(1, REACH + 1):
        same = np.flatnonzero(row[:-d] == row[d:]) if len(row) > d else np.zeros(0, np.int64)
        for a, b in ((slots[same], slots[same + d]), (slots[same + d], slots[same])):
            for place, sign in zip(*entries):
                flat += np.bincount(a * dim + place[b], weights=sign[b], minlength=len(flat))


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of features per text. vectors: index and context vectors side by side, by slot."""
    rows, d = len(offsets) - 1, vectors.shape[1]
    word, shape, row = token_slots(data, offsets)
    counts = np.bincount(row, minlength=rows).astype(np.float32)
    out = np.zeros((rows, 2 * d + 5), np.float32)
    for part, slots in enumerate((word, shape)):
        out[:, part * d : (part + 1) * d] = row_sums(vectors, slots, row, rows) / np.maximum(counts, 1)[:, None]
        for half in range(2):
            at = part * d + half * (d // 2)
            out[:, 2 * d + 2 * part + half] = np.linalg.norm(out[:, at : at + d // 2], axis=1)
    out[:, -1] = np.log1p(counts) / 5
    return out


@dataclass
class QualityModel:
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float
    prior: float | None = None  # instead of the network, where only one label was seen

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return softmax((self.logits(x) / self.temperature).astype(np.float64))[:, 1]


def fit_network(x: np.ndarray, y: np.ndarray, context: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, batch: int = 128, rate: float = 2e-3, decay: float = 1e-4, seed: int = SEED) -> QualityModel:
    ones = int((y == 1).sum())
    if ones in (0, len(y)):
        return QualityModel(context, *[np.zeros(0)] * 6, 1.0, (ones + 1) / (len(y) + 2))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, 2)), np.zeros(2)]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    z, target = (x - mean) / scale, np.eye(2)[y]
    best, best_loss = [w.copy() for w in p], np.inf
    for _ in range(epochs):
        rng.shuffle(used)
        for k in range(0, len(used), batch):
            i = used[k : k + batch]
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            g = (softmax(h @ p[2] + p[3]) - target[i]) / len(i)
            back = (g @ p[2].T) * (h > 0)
            grads = [z[i].T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], g.sum(axis=0)]
            t += 1
            for j, gj in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * gj
                v[j] = 0.999 * v[j] + 0.001 * gj * gj
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        if len(held):
            out = softmax(np.maximum(z[held] @ p[0] + p[1], 0) @ p[2] + p[3])
            loss = -np.log(out[np.arange(len(held)), y[held]] + 1e-12).mean()
            if loss < best_loss:
                best, best_loss = [w.copy() for w in p], loss
    model = QualityModel(context, mean, scale, *(best if len(held) else p), 1.0)
    model.temperature = fit_temperature(model.logits(x[held]), y[held]) if len(held) else 1.0
    return model


def _seen_sums(out: np.ndarray, kind: type = np.int32) -> Iterator[pa.RecordBatch]:
    """Hands on the rows of sums that are not all zero, a bounded number at once, and clears them."""
    seen = np.flatnonzero(out.any(axis=1))
    for k in range(0, len(seen), 4096):
        at = seen[k : k + 4096]
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * DIM), pa.array(out[at].astype(kind).reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), sums], names=["slot", "sums"])
    out[seen] = 0


def _context_table(docs: DataFrame, text: str) -> np.ndarray:
    """The context vectors of all texts, summed by slot on the executors. The sums are whole numbers,
    so they do not depend on the order of rows or tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, out = index_places(), np.zeros((SLOTS, DIM))
        waiting, rows, held, total = [], 0, 0, 0

        def add() -> None:
            word, shape, row = (np.concatenate(x) for x in zip(*waiting))
            context_sums(word, row, entries, out)
            context_sums(shape, row, entries, out)
            waiting.clear()

        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                word, shape, row = token_slots(*text_bytes(part.column(text)))
                waiting.append((word, shape, row + rows))
                rows, held, total = rows + part.num_rows, held + len(word), total + len(word)
                if held >= CONTEXT_WORDS:
                    add()
                    held = 0
                if total >= FLUSH_WORDS:
                    if waiting:
                        add()
                    held = total = 0
                    yield from _seen_sums(out)
        if waiting:
            add()
        yield from _seen_sums(out)

    def total_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((SLOTS, DIM))
        for batch in batches:
            np.add.at(out, batch.column("slot").to_numpy(), batch.column("sums").flatten().to_numpy().reshape(-1, DIM))
        yield from _seen_sums(out, np.int64)

    made = docs.select(text).mapInArrow(tidy(run), "slot int, sums array<int>")
    got = made.repartition("slot").mapInArrow(tidy(total_sums), "slot int, sums array<bigint>").toArrow()
    out = np.zeros((SLOTS, DIM), np.float64)
    out[got.column("slot").to_numpy()] = got.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def _vectors(context: np.ndarray) -> np.ndarray:
    index = index_vectors()
    return np.concatenate([index, context * np.float32(2)], axis=1)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_ROWS) -> QualityModel:
    """Learns from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    marked = labels.where(F.col(label).isNotNull() & (crc_fold(F.col(doc_id), FOLDS) != HELD_OUT))
    marked = marked.groupBy(F.col(doc_id).cast("bigint").alias("label_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    marked = bounded_sample(marked, F.col("label_id"), most, SEED).select("label_id", "y")  # at most `most` rows
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("label_id"), F.col(f"`{text}`").alias("text"))
    rows = texts.join(F.broadcast(marked), "label_id")
    rows_ = stage(rows.groupBy("label_id", "y").agg(F.min("text").alias("text")), "quality-train")
    rows = rows_.coalesce(TRAIN_TASKS)
    context = _context_table(texts, "text")
    shared = spark.sparkContext.broadcast(_vectors(context))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = pooled(*text_bytes(part.column("text")), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("label_id"), part.column("y"), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["label_id", "y", "x"])

    got = rows.mapInArrow(tidy(run), "label_id bigint, y int, x array<float>").toArrow()
    order = np.argsort(got.column("label_id").to_numpy(), kind="stable")
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 4 * DIM + 5)[order].astype(np.float64)
    y = got.column("y").to_numpy()[order].astype(np.int64)
    del got
    model = fit_network(x, y, context)
    shared.unpersist()
    unstage(rows_)
    del x
    release_memory()
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (default: all) with quality_score and quality_label."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("quality_score", "quality_label")]
    docs = docs.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([docs.schema[c] for c in kept] + T._parse_datatype_string("quality_score double, quality_label int").fields)
    arrow = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast((model, _vectors(model.context)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, vectors = shared.value
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                p = fitted.score(pooled(*text_bytes(part.column(text)), vectors).astype(np.float64)) if part.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], schema=arrow)

    return docs.mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs that the classifier accepts, with their columns as they were. Without labels of both kinds
    to learn from there is no classifier, and all documents stay."""
    model = train(docs, labels, **options)
    if model.prior is not None:
        return docs
    found = score(docs, model)
    return found.where(F.col("quality_label") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, train(docs, labels), keep=["doc_id"])
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_label").alias("predicted"))

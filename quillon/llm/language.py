"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

* Subwords are the byte n-grams of 2 to 4 bytes inside words and across one word boundary, lower-
  cased in ASCII and Latin-1, hashed into `BUCKETS`.
* A document is the mean of the embeddings of its subwords; a linear layer and a softmax follow.
  After training both are multiplied into one (bucket x language) table, so that scoring looks up
  one short row per subword, in one pass over whole texts without a shuffle.
* Training takes at most about `TRAIN_ROWS` rows, as many of each language, chosen by a hash of the
  id, and at most `MAX_LANGUAGES` languages (the most frequent). A fifth of the rows is held back to
  set the temperature and the score below which a prediction is marked as rejected.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing could be
learned; rows with a null id or language are never trained on; a null id is not held out; repeated
ids are trained on once. Other columns are kept or, if clashing, replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, bounded_batches, byte_class, slices, stage, table, text_bytes
from .training import crc_fold, fit_temperature, row_sums, softmax

BUCKETS = 1 << 15
DIM = 16
SIZES = (2, 3, 4)
TRAIN_ROWS = 3000
#: Languages that one model may have; more are an error, never left out.
MAX_LANGUAGES = 10_000
ACCEPTED_ERROR = 0.01
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
SEED = 11
PIECE = 256 << 10

_LETTER = byte_class(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every subword, rows ascending for each size in turn."""
    rows = len(offsets) - 1
    low = LOWER[data]
    capital = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3)) + 1
    low[capital] += 0x20
    low[~_LETTER[low]] = 0x20
    row = np.repeat(np.arange(rows), np.diff(offsets))
    text = np.full(len(low) + rows + 1, 0x20, np.uint32)
    text[np.arange(len(low)) + row + 1] = low
    letter = text != 0x20
    place = np.zeros(len(text), np.int64)
    place[np.arange(len(low)) + row + 1] = row
    inner = np.ones(len(text), bool)
    buckets, of = [], []
    for n in range(2, max(SIZES) + 1):
        m = len(text) - n + 1
        if m <= 0:
            break
        if n > 2:
            inner = inner[:m] & letter[n - 2 : n - 2 + m]
        if n not in SIZES:
            continue
        at = np.flatnonzero(inner[:m] & (letter[:m] | letter[n - 1 :]))
        code = np.zeros(len(at), np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | text[at + k]
        code = (code ^ np.uint32(n * 0x9E3779B1 % (1 << 32))) * np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(15)
        buckets.append((code * np.uint32(0xC2B2AE35) >> np.uint32(17)).astype(np.int64) % BUCKETS)
        of.append(np.maximum(place[at], place[at + n - 1]))
    return (np.concatenate(buckets), np.concatenate(of)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def mean_rows(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean of weights over the subwords of each text, a piece of the texts at a time."""
    rows = len(offsets) - 1
    sums, counts = np.zeros((rows, weights.shape[1])), np.zeros(rows)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1)
        for a, b in pieces(data, int(offsets[lo]), int(offsets[hi])) if hi == lo + 1 else [(int(offsets[lo]), int(offsets[hi]))]:
            bounds = np.clip(offsets[lo : hi + 1], a, b) - a
            bucket, row = subwords(data[a:b], bounds)
            sums[lo:hi] += row_sums(weights, bucket, row, hi - lo)
            counts[lo:hi] += np.bincount(row, minlength=hi - lo)
        lo = hi
    return sums / np.maximum(counts, 1)[:, None]


def pieces(data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Cuts of one long text, at an ASCII byte that is no letter where there is one."""
    while b - a > PIECE:
        cut = np.flatnonzero(~_LETTER[LOWER[data[a + PIECE // 2 : a + PIECE]]])
        to = a + PIECE // 2 + int(cut[-1]) if len(cut) else a + PIECE
        yield a, to
        a = to
    yield a, b


@dataclass
class LanguageModel:
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax((mean_rows(data, offsets, self.weights) + self.bias) / self.temperature)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, names: list[str], dim: int = DIM, epochs: int = 12, rate: float = 1.0, seed: int = SEED) -> LanguageModel:
    """rows: (buckets, shares) of each text; the shares add up to 1."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    e = rng.normal(0, 0.5, (BUCKETS, dim))
    w, b = rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    target = np.eye(len(names))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(used):
            at, share = rows[i]
            h = share @ e[at]
            g = softmax((h @ w + b)[None])[0] - target[y[i]]
            back = w @ g
            w -= step * np.outer(h, g)
            b -= step * 0.1 * g
            e[at] -= step * share[:, None] * back * 8
    model = LanguageModel(names, (e @ w).astype(np.float32), b)
    logits = np.array([share @ model.weights[at] + b for at, share in (rows[i] for i in held)]).reshape(len(held), len(names))
    model.temperature = fit_temperature(logits, y[held])
    if len(held):
        p = softmax(logits / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        down = np.argsort(-top, kind="stable")
        wrong = np.cumsum(~right[down]) / np.arange(1, len(held) + 1)
        good = np.flatnonzero(wrong <= ACCEPTED_ERROR)
        model.accept = float(top[down][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_ROWS) -> LanguageModel:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("id"), FOLDS) != HELD_OUT))
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    names = sorted(r["lang"] for r in counts)
    share = {r["lang"]: min(1.0, max(1, most // len(names)) / r["count"]) for r in counts}
    rates = docs.sparkSession.createDataFrame(pa.table({"lang": names, "y": pa.array(range(len(names)), pa.int32()), "rate": [share[n] for n in names]}))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 40)) < F.col("rate") * float(1 << 40)
    picked = rows.join(F.broadcast(rates), "lang").where(drawn).groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    picked = stage(picked, "language-train")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                data, offsets = text_bytes(part.column("text"))
                counts = np.zeros(BUCKETS)
                for a, b in pieces(data, 0, len(data)):
                    counts += np.bincount(subwords(data[a:b], np.array([0, b - a]))[0], minlength=BUCKETS)
                at = np.flatnonzero(counts)
                values = (counts[at] / max(counts.sum(), 1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([values], pa.list_(pa.float32()))], names=["id", "y", "at", "share"])

    got = picked.mapInArrow(run, "id bigint, y int, at array<int>, share array<float>").toPandas().sort_values("id", kind="stable")
    pairs = [(np.asarray(a, np.int64), np.asarray(s, np.float64)) for a, s in zip(got["at"], got["share"])]
    return fit(pairs, got["y"].to_numpy(np.int64), names)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (default: all) with lang_pred, lang_score and lang_rejected."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bounded_batches(spark)
    made = ("lang_pred", "lang_score", "lang_rejected")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    docs = docs.select(*dict.fromkeys([*kept, text]))
    sent = docs.withColumn("lang_rejected", F.coalesce(~F.col(text).rlike(r"\p{L}"), F.lit(True)))
    schema = T.StructType([docs.schema[c] for c in kept] + T._parse_datatype_string("lang_pred string, lang_score double, lang_rejected boolean").fields)
    arrow = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in slices(batch, text):
                none = part.column("lang_rejected").to_numpy(zero_copy_only=False).astype(bool)
                if not fitted.names:
                    none = np.ones(len(none), bool)
                    best, top = np.zeros(len(none), np.int64), np.zeros(len(none))
                else:
                    p = fitted.probabilities(*text_bytes(part.column(text)))
                    best, top = p.argmax(axis=1), p.max(axis=1)
                names = [UNKNOWN if x else fitted.names[k] for x, k in zip(none.tolist(), best.tolist())]
                top = np.where(none, 0.0, top)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(none | (top < fitted.accept))], schema=arrow)

    return sent.mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), keep=["doc_id"])
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))

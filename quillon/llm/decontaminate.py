"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned over training windows.

Each benchmark item gives its windows of `n` consecutive words (an item with fewer words, but not
none, is one window). Every document is scanned once in a Python worker: words are hashed over the
whole byte buffer, windows of each length that occurs are looked up in the hash set, and each hit
is compared word by word, so a hash collision never counts. There is no shuffle.

The executors cut the items into pieces of at most `PIECE_WORDS` words that overlap by a window less
a word, so that one long item is many pieces. The set of a block of pieces is a few flat arrays (about six
times its bytes) and travels as a broadcast only up to `block_bytes` of pieces; a larger benchmark is dealt
into blocks of that size by hash, and the documents pass one scan after another, each written before
the next.

Defined results: null and empty texts have no words and are clean; an empty benchmark hits nothing;
items repeated under one id count once; items without an id mark words but are not named;
extra columns are kept, and a clashing column of the input is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, U64, bounded_batches, run_hashes, slices, stage, table, text_bytes, tidy, unstage, word_hashes, words

WINDOW = 10
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 20_000
_BITS = 22
_AT_ONCE = 1 << 16


def item_pieces(items: DataFrame, n: int) -> DataFrame:
    """items: item, words (a text). Returns item, piece: lower-cased words with single blanks between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "words"):
                data, offsets = text_bytes(part.column("words"))
                data = LOWER[data]
                s, e, row = words(data, offsets, ALNUM)
                raw, first = data.tobytes(), np.searchsorted(row, np.arange(part.num_rows + 1))
                names, out = [], []
                for i, name in enumerate(part.column("item").to_pylist()):
                    a, b = int(first[i]), int(first[i + 1])
                    for k in range(a, max(a + 1, b - n + 1) if b > a else a, PIECE_WORDS):
                        names.append(name)
                        out.append(b" ".join(raw[x:y] for x, y in zip(s[k : min(b, k + PIECE_WORDS + n - 1)], e[k : min(b, k + PIECE_WORDS + n - 1)])).decode())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], names=["item", "piece"])

    return items.mapInArrow(tidy(run), "item string, piece string").distinct()


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + counts[i] - 1, one run after another."""
    upto = np.cumsum(counts)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - (upto - counts), counts)


def same_words(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the sizes[k] words from word i[k] of a and from word j[k] of b are the same bytes.
    a, b: (bytes, starts, ends of words)."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        n = sizes[part].astype(np.int64)
        x, y = _places(i[part], n), _places(j[part], n)
        length = (a[2][x] - a[1][x]).astype(np.int64)
        equal = length == b[2][y] - b[1][y]
        some = np.flatnonzero(equal)
        left, right = a[0][_places(a[1][x[some]], length[some])], b[0][_places(b[1][y[some]].astype(np.int64), length[some])]
        if len(some):
            equal[some] = np.logical_and.reduceat(left == right, np.cumsum(length[some]) - length[some])
        out[part] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


class WindowSet:
    """The windows of some pieces: sorted hashes with one place of each phrase and its items, and a
    bitmap before the search. Phrases whose hashes collide are in layers of their own."""

    def __init__(self, pieces: list[tuple[str | None, str]], n: int = WINDOW):
        self.names = sorted({i for i, _ in pieces if i is not None})
        number = {x: k for k, x in enumerate(self.names)}
        raw = [p.encode() for _, p in pieces]
        item = np.array([number.get(i, -1) for i, _ in pieces], np.int64)
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in raw]))).astype(np.int64)
        s, e, row = words(data, offsets, ALNUM)
        self.text = (data, s.astype(np.int32), e.astype(np.int32))
        counts = np.bincount(row, minlength=len(raw))
        size_of = np.minimum(n, counts)
        h = word_hashes(data, s, e)
        self.sizes = [int(x) for x in np.unique(size_of[counts > 0])]
        found = []
        for size in self.sizes:
            at = np.flatnonzero((row[: len(row) - size + 1] == row[size - 1 :]) & (size_of[row[: len(row) - size + 1]] == size))
            found.append((run_hashes(h, size)[at], at, np.full(len(at), size), item[row[at]]))
        hashes, at, sizes, items = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(zip(*found) if found else ((),) * 4, (U64, np.int64, np.int64, np.int64)))
        order = np.argsort(hashes, kind="stable")
        hashes, at, sizes, items = hashes[order], at[order], sizes[order], items[order]
        self.layers: list[tuple[np.ndarray, ...]] = []  # hash, word, size, first item place of each phrase; items
        while len(hashes):
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            group = np.cumsum(np.append(True, hashes[1:] != hashes[:-1])) - 1
            same = (sizes == sizes[first][group]) & same_words(self.text, at, self.text, at[first][group], np.minimum(sizes, sizes[first][group]))
            pairs = np.unique(np.stack([group[same & (items >= 0)], items[same & (items >= 0)]]), axis=1)
            self.layers.append((hashes[first], at[first].astype(np.int32), sizes[first].astype(np.uint16), np.searchsorted(pairs[0], np.arange(len(first) + 1)).astype(np.int32), pairs[1].astype(np.int32)))
            hashes, at, sizes, items = hashes[~same], at[~same], sizes[~same], items[~same]
        self.bitmap = np.zeros(1 << _BITS, bool)
        for layer in self.layers:
            self.bitmap[layer[0] >> U64(64 - _BITS)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray):
        """(words per row; row, first word in row and words of each hit window; row and item of each
        item that occurs, both ascending) of lower-cased texts."""
        s, e, row = words(data, offsets, ALNUM)
        counts = np.bincount(row, minlength=len(offsets) - 1)
        hits, named = [np.zeros((3, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        if len(s) and self.layers:
            h, first = word_hashes(data, s, e), np.cumsum(counts) - counts
            for size in self.sizes:
                runs = run_hashes(h, size)
                at = np.flatnonzero(self.bitmap[runs >> U64(64 - _BITS)])
                at = at[row[at] == row[at + size - 1]]
                for hashes, word, sizes, start, items in self.layers:
                    place = np.minimum(np.searchsorted(hashes, runs[at]), len(hashes) - 1)
                    near = (hashes[place] == runs[at]) & (sizes[place] == size)
                    k, p = at[near], place[near]
                    ok = same_words((data, s, e), k, self.text, word[p].astype(np.int64), np.full(len(k), size))
                    k, p = k[ok], p[ok]
                    hits.append(np.stack([row[k], k - first[row[k]], np.full(len(k), size)]))
                    once = np.unique(np.stack([row[k], p]), axis=1)
                    times = (start[once[1] + 1] - start[once[1]]).astype(np.int64)
                    named.append(np.stack([np.repeat(once[0], times), items[_places(start[once[1]].astype(np.int64), times)]]))
        return counts, np.concatenate(hits, axis=1), np.unique(np.concatenate(named, axis=1), axis=1)


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch inside a row as one, ascending."""
    order = np.lexsort((end, start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(row * wide + end)
    new = np.append(True, row[1:] * wide + start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], reach[np.append(at[1:], len(row)) - 1] - row[at] * wide


def _scan(window_set, out_schema: pa.Schema, text: str, kept: list[str], earlier: bool):
    """A mapInArrow function that adds n_words, hit_spans (disjoint, ascending, end exclusive) and item_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = window_set.value
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = text_bytes(part.column(text))
                counts, (row, start, size), (of, item) = found.find(LOWER[data], offsets)
                end, names = start + size, [[] for _ in range(part.num_rows)]
                for i, k in zip(of.tolist(), item.tolist()):
                    names[i].append(found.names[k])
                if earlier:
                    before = [(i, x["start"], x["end"]) for i, a in enumerate(part.column("hit_spans").to_pylist()) for x in a]
                    more = np.array(before, np.int64).reshape(-1, 3).T
                    row, start, end = np.concatenate([row, more[0]]), np.concatenate([start, more[1]]), np.concatenate([end, more[2]])
                    names = [sorted({*a, *b}) for a, b in zip(names, part.column("item_ids").to_pylist())]
                row, start, end = merged(row, start, end)
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)), spans)
                columns = [*(part.column(c) for c in kept), pa.array(counts, pa.int64()), spans.cast(out_schema.field("hit_spans").type), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (word positions) and item_ids of the benchmark windows found in them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = stage(item_pieces(benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("words")), n), "benchmark-pieces")
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // block_bytes))
    out = docs.drop("n_words", "hit_spans", "item_ids")
    base = T.StructType(list(out.schema.fields))
    full = T.StructType(base.fields + T._parse_datatype_string("n_words bigint, hit_spans array<struct<start:int,end:int>>, item_ids array<string>").fields)
    arrow = to_arrow_schema(full)
    for b in range(blocks):
        part = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == b)
        rows = part.toArrow()  # a block: about block_bytes
        window_set = spark.sparkContext.broadcast(WindowSet(list(zip(rows.column("item").to_pylist(), rows.column("piece").to_pylist())), n))
        scanned = out.mapInArrow(_scan(window_set, arrow, text, base.names, b > 0), full)
        if b + 1 < blocks:
            scanned = stage(scanned, "benchmark-scan")
            unstage(out)
        out = scanned
    unstage(pieces)
    return out


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those in which a benchmark window occurs; their columns as they were."""
    return find_leaks(docs, benchmark, **options).where(F.size("hit_spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs whose hit words are cut out of the text, from the first to the last word of each hit span."""
    from pyspark.sql.pandas.types import to_arrow_schema

    found = find_leaks(docs, benchmark, text=text, **options)
    schema = docs.schema
    arrow, names = to_arrow_schema(schema), docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = text_bytes(part.column(text))
                s, e, row = words(LOWER[data], offsets, ALNUM)
                first = np.searchsorted(row, np.arange(part.num_rows))
                values = part.column(text).to_pylist()
                for i, spans in enumerate(part.column("hit_spans").to_pylist()):
                    if not spans:
                        continue
                    out, at = [], offsets[i]
                    for x in spans:
                        out.append(data[at : s[first[i] + x["start"]]].tobytes())
                        at = e[first[i] + x["end"] - 1]
                    values[i] = b"".join([*out, data[at : offsets[i + 1]].tobytes()]).decode()
                columns = [pa.array(values, arrow.field(c).type) if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return found.mapInArrow(tidy(run), schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), doc_win AS (
  SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM doc_words, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
), hit AS (
  SELECT d.doc_id, d.k, d.size, w.item_id FROM doc_win d JOIN win w USING (size, phrase)
), marked AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS digest
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(m.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       coalesce(n.digest, sha256('')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN marked m USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

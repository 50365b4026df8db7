"""Token-ID output in patched frame-of-reference blocks.

A token file is a table of segments. A segment holds whole documents in ascending doc_id order
(null first, ties by a hash of the text) and one payload:

    b"QPFR", u32 ids, u32 blocks, u32 block starts [blocks + 1] (bytes after this index), blocks
    block: u32 minimum, u32 ids, u16 exceptions, u8 width, exceptions' u16 places and u32 values,
           then the low `width` bits of (id - minimum), least significant bit first

The minimum is subtracted, the width is that of the `PERCENTILE`-th of the rest, and larger values
go to the exception list. The block index lets a reader decode any range of ids by itself. Segments
are written by Spark's own Parquet writer, so any file system and the commit protocol serve; `start`
values are per partition until read, when the (few) partition totals are summed before them.

Texts are encoded by the `tokenizers` library. ASCII white space never lies inside a token of the
supported pre-tokenizer, so the library encodes each distinct chunk between spaces once per worker
and a bounded dictionary repeats the ids; `WordEncoder` refuses tokenizers for which that fails.

Defined results: a null text is empty and gives the end id alone; repeated rows and doc_ids each
get their own ids; an empty table gives an empty file. Extra columns are not written.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, slices, table, tidy

END_ID = 2
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 19
PERCENTILE = 98
CACHE_WORDS, KEPT_WORDS = 400_000, 200_000
MAGIC = b"QPFR"

SEGMENTS = "part int, segment int, doc_ids array<bigint>, n_tokens array<int>, local_start bigint, n_ids bigint, payload binary"


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(rest, k := min(len(rest) - 1, int(len(rest) * percentile / 100)))[k]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)).astype(np.uint8) & 1
    head = struct.pack("<IIHB", low, len(ids), len(over), width)
    return b"".join((head, over.astype("<u2").tobytes(), rest[over].astype("<u4").tobytes(), np.packbits(bits, bitorder="little").tobytes()))


def unpack_block(buf: memoryview) -> np.ndarray:
    low, n, over, width = struct.unpack_from("<IIHB", buf)
    places = np.frombuffer(buf, "<u2", over, 11)
    values = np.frombuffer(buf, "<u4", over, 11 + 2 * over)
    packed = np.frombuffer(buf, np.uint8, (n * width + 7) // 8, 11 + 6 * over)
    rest = np.zeros(n, np.uint32)
    bits = np.unpackbits(packed, count=n * width, bitorder="little").reshape(n, width)
    for k in range(width):
        rest |= bits[:, k].astype(np.uint32) << np.uint32(k)
    rest[places] = values
    return rest + np.uint32(low)


def pack_ids(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    if block_ids > 1 << 16:
        raise ValueError("places of exceptions have 16 bits")
    blocks = [pack_block(ids[k : k + block_ids]) for k in range(0, len(ids), block_ids)]
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.int64))).astype("<u4")
    return b"".join((MAGIC, struct.pack("<II", len(ids), len(blocks)), starts.tobytes(), *blocks))


def unpack_ids(payload: bytes, first: int = 0, last: int | None = None, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The ids [first, last) of a payload; only their blocks are decoded."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token payload")
    n, blocks = struct.unpack_from("<II", payload, 4)
    last = n if last is None else min(last, n)
    starts, at = np.frombuffer(payload, "<u4", blocks + 1, 12), 12 + 4 * (blocks + 1)
    if first >= last:
        return np.zeros(0, np.uint32)
    view, a, b = memoryview(payload), first // block_ids, (last - 1) // block_ids
    ids = np.concatenate([unpack_block(view[at + int(starts[k]) : at + int(starts[k + 1])]) for k in range(a, b + 1)])
    return ids[first - a * block_ids : last - a * block_ids]


_PLAIN = re.compile(rb"[a-z]+").fullmatch
#: Latin-1 letters: composed already, and lower-cased one by one.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Bytes of ASCII and of U+00C0 to U+00FF in UTF-8.
_LATIN_BYTES = bytes([*range(0xC0), 0xC3])
#: Letters, digits and spaces to "a", points and commas to ".", all else to "!".
_KINDS = bytes(0x2E if b in b".," else 0x61 if b >= 128 or chr(b).isalnum() or b in b" \t\n\r\x0b\x0c" else 0x21 for b in range(256))


def _byte_chars() -> list[str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordEncoder(dict):
    """Chunk between white space to a number; the ids of number k are flat[starts[k]:][:lengths[k]]."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"]["type"] == "Sequence" else {}
        if split.get("behavior") != "Removed" or any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("only pre-tokenizers that drop white space are supported")
        self.library, self.model, self.end_id, self.chars = Tokenizer.from_file(path), None, end_id, _byte_chars()
        self.model = self.library.model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.starts, self.lengths = array("I", [self.end_id]), array("q", [0]), array("i", [1])
        self[None] = 0

    def trim(self) -> None:
        """Forget all but the chunks met first, which are the most frequent ones."""
        kept = dict(islice(self.items(), KEPT_WORDS))
        self.clear()
        self.update(kept)
        del self.flat[self.starts[KEPT_WORDS] :], self.starts[KEPT_WORDS:], self.lengths[KEPT_WORDS:]

    def ids_of(self, chunk: bytes) -> list[int]:
        if _PLAIN(chunk):
            return [t.id for t in self.model.tokenize(chunk.decode())]
        text = chunk.decode()
        if _LATIN(text):
            return [t.id for t in self.model.tokenize("".join(map(self.chars.__getitem__, text.lower().encode())))]
        return self.library.encode(text, add_special_tokens=False).ids

    def __missing__(self, chunk: bytes) -> int:
        ids = self.ids_of(chunk)
        self[chunk] = k = len(self.starts)
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids))
        self.flat.extend(ids)
        return k

    def chunks(self, text: bytes) -> list[bytes]:
        """Chunks with the same tokens as the text: Latin-1 texts are lower-cased in ASCII and points and
        commas after a letter or digit cut off, where neither can change a token. (Of U+00C0 to U+00FF
        only the signs for times and divide are no letters, and there are no combining marks.)"""
        if b"<|" not in text and not text.translate(None, _LATIN_BYTES) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text:
            text = text.lower()
            kinds = text.translate(_KINDS)
            if b"!." not in kinds and b".." not in kinds:
                text = text.replace(b".", b" .").replace(b",", b" ,")
        return text.split()

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; number of ids of each)."""
        if len(self) > CACHE_WORDS:
            self.trim()
        parts, ends = [], []
        for text in texts:
            parts += self.chunks(text) if text else ()
            parts.append(None)
            ends.append(len(parts))
        at = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        lengths = np.frombuffer(self.lengths, np.int32)[at].astype(np.int64)
        upto = np.cumsum(lengths)
        place = np.repeat(np.frombuffer(self.starts, np.int64)[at] - (upto - lengths), lengths)
        place += np.arange(len(place))
        return np.frombuffer(self.flat, np.uint32)[place], np.diff(upto[np.array(ends, np.int64) - 1], prepend=0)


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def encode_segments(docs: DataFrame, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The segments of docs in ascending doc_id order. tokenizer: a path that all executors have."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(docs.sparkSession)
    schema = T._parse_datatype_string(SEGMENTS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), encoder(tokenizer, end_id)
        seg = start = held = 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            row = [[part], [seg], [pa.concat_arrays(names).to_pylist()], [np.concatenate(counts)], [start], [held], [pack_ids(np.concatenate(ids))]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for rows in slices(batch, "text"):
                got, n = words.encode(rows.column("text").cast(pa.binary()).to_pylist())
                ids.append(got)
                counts.append(n)
                names.append(rows.column("doc_id"))
                held += len(got)
                if held >= SEGMENT_IDS:
                    yield flush()
                    seg, start, held = seg + 1, start + held, 0
                    ids, counts, names = [], [], []
        if held:
            yield flush()

    tie = F.xxhash64("text")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie).mapInArrow(tidy(run), schema)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    encode_segments(docs, tokenizer, **options).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    files = spark.read.schema(SEGMENTS).parquet(path)
    schema = T._parse_datatype_string("part int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got, n = unpack_ids(row["payload"]), np.array(row["n_tokens"], np.int64)
                upto = np.cumsum(n)
                raw = memoryview(got.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(upto.tolist(), n.tolist())]
                columns = [[row["part"]] * len(n), row["doc_ids"], upto - n + row["local_start"], n, crc]
                if ids:
                    columns.append([got[b - k : b] for b, k in zip(upto.tolist(), n.tolist())])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)

    # one row per partition of the writer
    before = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = files.select("part", "doc_ids", "n_tokens", "local_start", "payload").mapInArrow(tidy(run), schema)
    out = found.join(F.broadcast(before), found["part"] == before["of"])
    return out.select("doc_id", (F.col("local_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_digest(table(spark, sf_dir, "documents"))


def documents_digest(docs: DataFrame) -> DataFrame:
    """docs written as a token file in the shared folder, and what is read back from it."""
    import public_tokenizers

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)

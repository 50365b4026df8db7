"""What the corpus operators share: staging in the cluster's shared folder, bounded Arrow slices
and word splitting over whole byte buffers.

Texts are handled as UTF-8 bytes. Every separator used here is an ASCII character, so a byte
class is the same as a code-point class, and all bytes from 0x80 on belong to words.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker; one longer text is still handled whole.
SLICE_BYTES = 2 << 20
#: Arrow bytes that Spark sends to a Python worker at once.
ARROW_BYTES = 4 << 20
#: A counted table up to this size is broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 16 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and
    the master is local; on a cluster the setting is required."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives executors.

    The shuffle files of the write are of no use after it, and Spark is told to remove them then.
    The table itself stays until `unstage`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Delete staged tables of which nothing is read any more, as their successors are written."""
    for df in tables:
        if df is not None and getattr(df, "_staged_at", None):
            delete_path(df.sparkSession, df._staged_at)
            df._staged_at = None


def small_or_not(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for a broadcast if its counted rows of row_bytes each stay within BROADCAST_BYTES."""
    return F.broadcast(df) if df.limit(BROADCAST_BYTES // row_bytes + 1).count() <= BROADCAST_BYTES // row_bytes else df


def trim_memory() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release_memory() -> None:
    """Collect and give back what this process no longer uses: the driver holds no fitted tables for good."""
    gc.collect()
    trim_memory()


def tidy(run: Callable) -> Callable:
    """run over batches, and then freed memory given back, as the worker stays for tasks of later stages."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim_memory()

    return runs


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def setting_bytes(value: str) -> int:
    """The bytes of a Spark size setting such as 67108864, 64m or 64MB."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([bkmgt]?)i?b?\s*", str(value).lower())
    if not found:
        raise ValueError(f"not a size: {value}")
    return int(found[1]) * _UNITS[found[2]]


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that long texts do not add up in a worker. A lower bound of
    the session is kept; the setting stays, as plans read it when they run."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if setting_bytes(spark.conf.get(key)) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with at most `most` bytes of text each, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty texts. offsets has one entry more than rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"") if column.null_count else column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_class(inside) -> np.ndarray:
    """A table of 256 flags from a predicate on byte values."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words `[^\x20\x09-\x0D]+`.
SPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Lower-cases A-Z and nothing else.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word. Words end at row boundaries."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    flag = np.zeros(len(data) + 1, bool)
    np.take(inside, data, out=flag[:-1])
    before = np.empty_like(flag)
    before[0] = False
    before[1:] = flag[:-1]
    after_row = offsets[1:-1]
    cut = after_row[after_row < len(data)]
    starts_at = flag & ~before
    ends_at = before & ~flag
    starts_at[cut] |= flag[cut]
    ends_at[cut] |= before[cut]
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, U64)
    if n > 1:
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POW_BASE = 0xD6E8FEB86659FD93
_POW_INV = pow(_POW_BASE, -1, 1 << 64)
_SEGMENT = 1 << 19
_CACHE: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse."""
    if len(_CACHE.get("up", ())) < n:
        _CACHE["up"], _CACHE["down"] = _powers(n, _POW_BASE), _powers(n, _POW_INV)
    up, down = _CACHE["up"][:n], _CACHE["down"][:n]
    if n > 2 * _SEGMENT:  # of one very long text: not kept
        _CACHE.clear()
    return up, down


_BYTE_CODE = mix64((np.arange(256, dtype=U64) + U64(1)) * _ODD)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes from running sums, then finalised."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + _SEGMENT, side="right")))
        s, e = starts[at:to] - lo, ends[at:to] - lo
        n = int(e[-1])
        up, down = power_tables(max(n, _SEGMENT) if n <= _SEGMENT else n)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_CODE[data[lo : lo + n]] * up[:n], out=sums[1:])
        out[at:to] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * _ODD)
        at = to
        if n > _SEGMENT:
            _CACHE.clear()
    return out


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive word hashes (crossing rows; the caller masks those)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out *= U64(_POW_BASE)
        out += hashes[k : k + m]
    return mix64(out + U64(n * int(_ODD) % (1 << 64)))


def schema_with(df: DataFrame, **columns: str):
    """df's schema with more columns, given as DDL types."""
    from pyspark.sql import types as T

    return T.StructType(list(df.schema.fields) + [T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

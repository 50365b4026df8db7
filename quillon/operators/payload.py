"""Encoded tensors as bytes: assembly of groups into one checksummed payload, and its reader.

The body of a payload is its groups in order. A group is 9 bytes of metadata (u8 width, f32 minimum,
f32 scale, little-endian) and its codes packed most significant bit first, or its raw elements in
their own type where the width is 0. A header with n_groups 0 marks a bypass payload: the body is
the raw elements of the whole tensor in position order.

A payload is one binary value, so a tensor stays below Spark's 2 GB for a value; groups are packed
in Arrow slices, and only a tensor's own bytes ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import ELEMENT_BYTES, round_to
from ..sources import wire
from . import codec


def raw_bytes(values: np.ndarray, dtype: str) -> bytes:
    """float32 values, already of the type's precision, as elements of the type; NaN payload bits stay."""
    x = np.ascontiguousarray(values, np.float32)
    if dtype == "bf16":
        return (x.view(np.uint32) >> np.uint32(16)).astype("<u2").tobytes()
    return x.astype("<f2" if dtype == "fp16" else "<f4").tobytes()


def from_raw(data: bytes, dtype: str) -> np.ndarray:
    if dtype == "bf16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)
    return np.frombuffer(data, "<f2" if dtype == "fp16" else "<f4").astype(np.float32)


def pack(codes: np.ndarray, width: int) -> bytes:
    bits = (codes[:, None] >> np.arange(width - 1, -1, -1)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width).astype(np.int32)
    return bits @ (1 << np.arange(width - 1, -1, -1, dtype=np.int32))


def _group_record(width: int, low: float, scale: float, codes: np.ndarray, values: np.ndarray, dtype: str) -> bytes:
    head = bytes([width]) + np.array([low, scale], "<f4").tobytes()
    return head + (pack(codes, width) if width else raw_bytes(values, dtype))


def _restored(codes: np.ndarray, low: np.float32, scale: np.float32, dtype: str) -> np.ndarray:
    """As the encoder restores them: float32 steps, then half-even to the type."""
    x = (low + codes.astype(np.float32) * scale).astype(np.float32)
    if dtype == "bf16":
        bits = x.view(np.uint32).astype(np.uint64)
        even = bits + np.uint64(0x7FFF) + ((bits >> np.uint64(16)) & np.uint64(1))
        return (even.astype(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32)
    return x.astype(np.float16).astype(np.float32) if dtype == "fp16" else x


def write(encoded: codec.Encoded, channels: int | None = None) -> DataFrame:
    """tensor_id, payload: one checksummed binary per tensor. Tensors that are too small are bypassed."""
    cfg, dtype = encoded.cfg, encoded.cfg.dtype
    keys = ["tensor_id", "group_id"]
    kept = encoded.groups.select(*keys, F.col("width").alias("kept_width"))
    place = F.array_sort(F.collect_list(F.struct("pos", "code", "value")))
    rows = encoded.elements.join(kept, keys).groupBy(*keys).agg(F.max("kept_width").alias("width"), F.max("gmin").alias("gmin"), F.max("scale").alias("scale"), place.alias("of"))
    rows = rows.select(*keys, "width", "gmin", "scale", F.col("of.code").alias("codes"), F.col("of.value").alias("values"), F.col("of.pos").alias("places"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("codes", "values", "places")}
            ends = np.cumsum(batch.column("codes").value_lengths().to_numpy(zero_copy_only=False))
            out, raw, at, a = [], [], [], 0
            for b, w, low, scale in zip(ends.tolist(), *(batch.column(c).to_pylist() for c in ("width", "gmin", "scale"))):
                out.append(_group_record(w, low, scale, lists["codes"][a:b], lists["values"][a:b], dtype))
                raw.append(raw_bytes(lists["values"][a:b], dtype))
                at.append(lists["places"][a:b].astype("<i8").tobytes())
                a = b
            yield pa.RecordBatch.from_arrays([batch.column("tensor_id"), batch.column("group_id"), pa.array(out, pa.binary()), pa.array(raw, pa.binary()), pa.array(at, pa.binary())], names=["tensor_id", "group_id", "part", "raw", "places"])

    packed = rows.mapInArrow(parts, "tensor_id string, group_id bigint, part binary, raw binary, places binary")

    def join(groups: pa.Table) -> pa.Table:
        order = np.argsort(groups.column("group_id").to_numpy(), kind="stable")
        take = lambda c: groups.column(c).take(pa.array(order)).to_pylist()
        raw, n = b"".join(take("raw")), groups.num_rows
        size = ELEMENT_BYTES[dtype]
        tiny = len(raw) < cfg.block_size * size
        if tiny:
            by_place = np.argsort(np.frombuffer(b"".join(take("places")), "<i8"), kind="stable")
            raw = np.frombuffer(raw, f"V{size}")[by_place].tobytes()
        parts_ = [] if tiny else take("part")
        widths = sorted({p[0] for p in parts_} - {0})
        return pa.table({"tensor_id": groups.column("tensor_id")[:1], "body": pa.array([raw if tiny else b"".join(parts_)], pa.binary()), "n_groups": pa.array([0 if tiny else n], pa.int32()), "bit_width": pa.array([widths[0] if len(widths) == 1 else -1], pa.int32()), "n": pa.array([len(raw) // size], pa.int64())})

    body = packed.groupBy("tensor_id").applyInArrow(join, "tensor_id string, body binary, n_groups int, bit_width int, n bigint")
    shape = F.array(F.col("n").cast("int")) if channels is None else F.array(F.call_function("div", F.col("n"), F.lit(channels).cast("bigint")).cast("int"), F.lit(channels))
    header = {"eps": F.lit(float(cfg.eps)), "allocation": F.lit(cfg.allocation if channels else "blockwise"), "bit_width": F.col("bit_width"), "original_dtype": F.lit(dtype), "original_shape": shape, "block_size": F.lit(cfg.block_size), "n_groups": F.col("n_groups")}
    return body.select("tensor_id", wire.write(header, F.col("body")).alias("payload"))


def decode_body(body: bytes, allocation: str, dtype: str, shape: list[int], block: int, n_groups: int) -> np.ndarray:
    """The values of one payload, by position from 0. A body of another length is an error."""
    n, size = int(np.prod(shape)), ELEMENT_BYTES[dtype]
    if n_groups == 0:
        if len(body) != n * size:
            raise ValueError("bad payload: length")
        return from_raw(body, dtype)
    places = np.arange(n).reshape(shape)
    groups = [places.ravel()[a : a + block] for a in range(0, n, block)] if allocation == "blockwise" else list(places.T if allocation == "per_channel" else places)
    out, at = np.empty(n, np.float32), 0
    if len(groups) != n_groups:
        raise ValueError("bad payload: groups")
    for where in groups:
        width = body[at] if at < len(body) else 255
        length = len(where) * size if width == 0 else (len(where) * width + 7) // 8
        if width not in (0, *codec.WIDTHS) or at + codec.GROUP_BYTES + length > len(body):
            raise ValueError("bad payload: length")
        low, scale = np.frombuffer(body, "<f4", 2, at + 1)
        data = body[at + codec.GROUP_BYTES : at + codec.GROUP_BYTES + length]
        out[where] = from_raw(data, dtype) if width == 0 else _restored(unpack(data, width, len(where)), low, scale, dtype)
        at += codec.GROUP_BYTES + length
    if at != len(body):
        raise ValueError("bad payload: length")
    return out


def read(payloads: DataFrame, strict: bool = True) -> DataFrame:
    """tensor_id, pos (from 0 within the tensor), value of payloads. With strict a damaged payload is an
    error; otherwise it gives one row with its problem and no value."""
    rows = payloads.select("tensor_id", wire.read(F.col("payload"), strict).alias("p"))
    rows = rows.select("tensor_id", "p.body", "p.problem", *[F.col(f"p.header.{c}").alias(c) for c in ("allocation", "original_dtype", "original_shape", "block_size", "n_groups")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                problem, x = r["problem"], np.zeros(0, np.float32)
                if problem is None:
                    try:
                        x = decode_body(r["body"], r["allocation"], r["original_dtype"], r["original_shape"], r["block_size"], r["n_groups"])
                    except ValueError as e:
                        if strict:
                            raise
                        problem = str(e)
                n = max(1, len(x)) if problem else len(x)
                value = pa.array([None], pa.float32()) if problem else pa.array(x, pa.float32())
                yield pa.RecordBatch.from_arrays([pa.array([r["tensor_id"]] * n, pa.string()), pa.array(np.arange(n), pa.int64()), value, pa.array([problem] * n, pa.string())], names=["tensor_id", "pos", "value", "problem"])

    out = rows.mapInArrow(run, "tensor_id string, pos bigint, value float, problem string")
    return out.drop("problem") if strict else out


def bypass(elements: DataFrame, dtype: str, block_size: int = 256) -> DataFrame:
    """tensor_id, payload of tensors passed through: raw bytes, no groups, ratio 1."""
    cfg = codec.CodecConfig(1.0, block_size=1 << 30, dtype=dtype)
    return write(codec.encode(elements, cfg), None)


def damage(payload: Column, fault: str) -> Column:
    """A payload with one fault: a flipped bit in its body, or its second half cut off."""
    if fault == "truncated":
        return F.substring(payload, F.lit(1), F.floor(F.length(payload) / 2).cast("int"))
    last = F.conv(F.hex(F.substring(payload, -1, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(1))
    return F.concat(F.substring(payload, F.lit(1), F.length(payload) - 1), F.unhex(F.lpad(F.hex(last.cast("bigint")), 2, "0")))


def detected(payloads: DataFrame, faults: tuple[str, ...] = ("bit_flip", "truncated")) -> DataFrame:
    """Each fault and none: payloads, and how many the reader rejects. One pass over the payloads."""
    cases = F.array(F.struct(F.lit("none").alias("fault"), F.col("payload").alias("bytes")), *[F.struct(F.lit(f).alias("fault"), damage(F.col("payload"), f).alias("bytes")) for f in faults])
    rows = payloads.select("tensor_id", F.explode(cases).alias("c")).select("tensor_id", "c.fault", wire.read(F.col("c.bytes"), strict=False).alias("p"))
    return rows.groupBy("fault").agg(F.count("*").alias("payloads"), F.count_if(F.col("p.problem").isNotNull()).alias("rejected"))


def same_bits(a: Column, b: Column) -> Column:
    """Whether two floats are the same bit for bit, NaN payloads and signs of zero included."""
    bits = lambda x: F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float"))
    return bits(a) == bits(b)


def as_dtype(elements: DataFrame, dtype: str) -> DataFrame:
    return elements.withColumn("value", round_to("value", dtype))

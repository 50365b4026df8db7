"""A checksummed payload: 4 magic bytes, u32 little-endian header length, JSON header, body.

The header holds the CRC-32 of the body. Reading rejects a wrong magic, version or checksum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC, VERSION = b"QWF1", 1
HEADER = "codec_version int, eps double, allocation string, bit_width int, original_dtype string, original_shape array<int>, block_size int, n_groups int, compressed_bytes bigint, crc32 bigint"


def little_endian(n: Column, size: int) -> Column:
    """n as `size` bytes, least significant first."""
    digits = F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def from_little_endian(b: Column, size: int) -> Column:
    digits = F.hex(b)
    return F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]), 16, 10).cast("bigint")


def write(header: dict[str, Column], body: Column) -> Column:
    """The payload of a body with header fields."""
    fields = {"codec_version": F.lit(VERSION), **header, "compressed_bytes": F.length(body).cast("bigint"), "crc32": F.crc32(body)}
    text = F.encode(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])), "utf-8")
    return F.concat(F.lit(bytearray(MAGIC)), little_endian(F.length(text), 4), text, body)


def read(payload: Column, strict: bool = True) -> Column:
    """struct(header, body, problem); with strict, a problem is an error when the query runs."""
    n = from_little_endian(F.substring(payload, 5, 4), 4).cast("int")
    header = F.from_json(F.decode(F.substring(payload, F.lit(9), n), "utf-8"), HEADER)
    body = F.substring(payload, 9 + n, F.length(payload))
    problem = (
        F.when(F.substring(payload, 1, 4) != F.lit(bytearray(MAGIC)), "magic")
        .when(F.coalesce(header["codec_version"], F.lit(-1)) != VERSION, "version")
        .when(F.coalesce(header["crc32"], F.lit(-1)) != F.crc32(body), "crc")
    )
    if strict:  # on every field, as those that are not read are pruned
        error = F.raise_error(F.concat(F.lit("bad payload: "), problem))
        header = F.when(problem.isNull(), header).otherwise(F.from_json(error.cast("string"), HEADER))
        body = F.when(problem.isNull(), body).otherwise(error.cast("binary"))
        problem = F.when(problem.isNotNull(), error.cast("string"))
    return F.struct(header.alias("header"), body.alias("body"), problem.alias("problem"))

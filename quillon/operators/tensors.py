"""Tensors as long tables: tensor_id, pos, row_id, channel, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Three layouts of a [head, token, channel] field: which index runs slowest, next and fastest.
LAYOUTS = {"HSD": ("h", "s", "d"), "TD": ("s", "h", "d"), "HDS": ("h", "d", "s")}


def from_rows(rows: DataFrame, tensor: Column, row: str, values: str) -> DataFrame:
    """One matrix per tensor from rows of arrays; row numbers the rows within it from 0."""
    exploded = rows.select(tensor.alias("tensor_id"), F.col(row).cast("bigint").alias("row_id"), F.size(values).alias("width"), F.posexplode(values).alias("channel", "value"))
    return exploded.select("tensor_id", (F.col("row_id") * F.col("width") + F.col("channel")).alias("pos"), "row_id", "channel", F.col("value").cast("float").alias("value"))


def layout_positions(field: DataFrame, heads: int, tokens: int, channels: int, layout: str) -> DataFrame:
    """field (h, s, d, value) with the position of each value in a layout."""
    size = {"h": heads, "s": tokens, "d": channels}
    a, b, c = LAYOUTS[layout]
    pos = (F.col(a) * size[b] + F.col(b)) * size[c] + F.col(c)
    return field.select("*", F.lit(layout).alias("layout"), pos.cast("bigint").alias("pos"))


def all_layouts(field: DataFrame, heads: int, tokens: int, channels: int) -> DataFrame:
    parts = [layout_positions(field, heads, tokens, channels, x) for x in LAYOUTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def file_columns(path: Column) -> tuple[Column, Column]:
    """(layer, kind) from names such as l05_k."""
    name = F.regexp_extract(path, r"l(\d+)_([kv])(?:\.\w+)?$", 0)
    layer = F.regexp_extract(name, r"l(\d+)_", 1)
    kind = F.regexp_extract(name, r"_([kv])", 1)
    return F.when(layer != "", layer.cast("int")), F.when(kind != "", kind)

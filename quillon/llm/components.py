"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (pre-aggregated before its shuffle) and a join back. The minima are
written before they are joined, so that both sides of the join are plain shuffles, of which Spark
splits the partition of a node with very many edges. Each round's table replaces the last.

The edges are done when every component is a star around its smallest node, that is when no node
with a smaller neighbour has another neighbour; the minima of a round show that by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, root for all nodes but the roots; root is the smallest node. A staged table.

    Loops, repeated and reversed edges and nulls do no harm; no edges give no rows."""
    a, b = F.col("a"), F.col("b")
    now = stage(edges.where((a != b)).select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct(), "cc")
    while True:
        both = now.select(F.col("big").alias("u"), F.col("small").alias("v")).union(now.select("small", "big"))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")), "cc-low")
        if not low.agg(F.max(((F.col("m") < F.col("u")) & (F.col("edges") > 1)).cast("int"))).first()[0]:
            out = stage(now.select(F.col("big").alias("node"), F.col("small").alias("root")), "cc-roots")
            unstage(now, low)
            return out
        large = stage(both.join(low.select("u", "m"), "u").where("v > u").select(F.col("v").alias("big"), F.least("m", "u").alias("small")), "cc-large")
        unstage(low)
        low = stage(large.groupBy("big").agg(F.min("small").alias("m")), "cc-low")
        small = large.join(low, "big").select(F.when(F.col("small") == F.col("m"), F.col("big")).otherwise(F.col("small")).alias("u"), "m", F.col("big").alias("w"))
        after = stage(small.select(F.col("u").alias("big"), F.col("m").alias("small")).union(small.select("w", "m")).distinct(), "cc")
        unstage(now, large, low)
        now = after

"""Queries over payloads, flat files, manifests, synthetic fields and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import numerics
from ..operators import checks
from ..sources import flatfile, manifest, synthetic, wire
from ..streaming import trials as stream
from .base import TRIALS, query, rounded, table
from .base import trials as trial_rows


def _bodies(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.encode(F.concat("text", F.lit("#"), F.col("item_id").cast("string")), "utf-8").alias("body"))


@query("wire_round_trip", "SELECT item_id, octet_length(encode(text || '#' || item_id)) AS compressed_bytes, CAST(NULL AS VARCHAR) AS problem, true AS same, 'crc' AS flipped, 'magic' AS wrong_magic FROM benchmark")
def wire_round_trip(spark, sf_dir):
    """Written and read payloads; a flipped byte and a wrong magic are found."""
    header = {"eps": F.lit(0.05), "allocation": F.lit("blockwise"), "bit_width": F.lit(6), "block_size": F.lit(256)}
    rows = _bodies(spark, sf_dir).withColumn("payload", wire.write(header, F.col("body"))).withColumn("got", wire.read(F.col("payload")))
    n = F.length("payload")
    rows = rows.withColumn("bad", wire.read(F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(bytearray(b"~"))), strict=False))
    rows = rows.withColumn("odd", wire.read(F.concat(F.lit(bytearray(b"XXXX")), F.substring(F.col("payload"), F.lit(5), n)), strict=False))
    return rows.select("item_id", "got.header.compressed_bytes", "got.problem", (F.col("got.body") == F.col("body")).alias("same"), F.col("bad.problem").alias("flipped"), F.col("odd.problem").alias("wrong_magic"))


@query("flat_file_offsets", "WITH p AS (SELECT item_id % 4 AS file, item_id, octet_length(encode(text || '#' || item_id)) AS n FROM benchmark) SELECT file, item_id, CAST(coalesce(sum(n) OVER (PARTITION BY file ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", n AS length, true AS same, false AS short_read FROM p")
def flat_file_offsets(spark, sf_dir):
    pieces = _bodies(spark, sf_dir).withColumn("file", F.pmod("item_id", F.lit(4)))
    offsets = flatfile.offset_table(pieces, "file", "item_id", "body")
    back = flatfile.read_pieces(flatfile.concatenate(pieces, "file", "item_id", "body"), offsets, "file")
    both = back.join(pieces.select("item_id", "body"), "item_id")
    return both.select("file", "item_id", "offset", "length", (F.col("piece") == F.col("body")).alias("same"), "short_read")


@query("delivery_checks", "SELECT item_id, octet_length(encode(text || '#' || item_id)) AS expected, CASE WHEN item_id % 5 = 0 THEN 3 ELSE octet_length(encode(text || '#' || item_id)) END AS \"read\", item_id % 5 = 0 AS short_read, item_id % 5 <> 0 AS exact FROM benchmark")
def delivery_checks(spark, sf_dir):
    source = _bodies(spark, sf_dir)
    cut = source.withColumn("body", F.when(F.col("item_id") % 5 == 0, F.substring("body", 1, 3)).otherwise(F.col("body")))
    return checks.delivery(source, cut, "item_id", "body")


@query("body_hashes", "SELECT doc_id, substr(sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS normalised, substr(sha1(text), 1, 16) AS raw FROM documents")
def body_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numerics.short_hash(numerics.squeeze_spaces("text")).alias("normalised"), numerics.short_hash("text").alias("raw"))


@query("manifest_tall", "SELECT 'd' || o_custkey % 9 AS doc, o_orderkey % 28 AS layer, CASE WHEN o_orderkey % 2 = 0 THEN 'k' ELSE 'v' END AS kind, c, mode, round(o_totalprice / 1000 / c, 6) AS ratio FROM orders, (VALUES (0.1, 'fixed'), (0.03, 'plain')) t(c, mode) WHERE o_totalprice > 0")
def manifest_tall(spark, sf_dir):
    """Observations written as JSON with results keyed by c and mode, read and made tall."""
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d"), (F.col("o_custkey") % 9).cast("string")).alias("doc"), (F.col("o_orderkey") % 28).cast("int").alias("layer"), F.when(F.col("o_orderkey") % 2 == 0, "k").otherwise("v").alias("kind"),
        F.col("o_totalprice").alias("std"), F.create_map(*[x for c, m in ((0.1, "fixed"), (0.03, "plain")) for x in (F.lit(f"c{c}_{m}"), F.struct((F.col("o_totalprice") / 1000 / c).alias("ratio")))]).alias("cuszp"),
    )
    text = rows.select(F.from_json(F.to_json(F.struct("*")), manifest.OBSERVATION).alias("o")).select("o.*")
    return manifest.tall_observations(text).select("doc", "layer", "kind", F.col("c").cast("decimal(3,2)").alias("c"), "mode", F.round("ratio", 6).alias("ratio"))


@query("file_columns", "SELECT vec_id, CAST(label // 2 AS INT) AS layer, CASE WHEN label % 2 = 0 THEN 'k' ELSE 'v' END AS kind FROM embeddings")
def file_columns(spark, sf_dir):
    from ..operators.tensors import file_columns as parse

    name = F.format_string("/data/l%02d_%s.pt", F.floor(F.col("label") / 2).cast("int"), F.when(F.col("label") % 2 == 0, "k").otherwise("v"))
    layer, kind = parse(name)
    return table(spark, sf_dir, "embeddings").select("vec_id", layer.alias("layer"), kind.alias("kind"))


@query("cost_keys", "SELECT 'w' || w || '_(' || s || ', 2048)' AS key, w AS bit_width, CAST(s AS BIGINT) * 2048 AS numel FROM (VALUES (4), (6), (8)) a(w), (VALUES (64), (512)) b(s)")
def cost_keys(spark, sf_dir):
    rows = spark.createDataFrame([(f"w{w}_({s}, 2048)",) for w in (4, 6, 8) for s in (64, 512)], ["key"])
    return manifest.cost_candidates(rows)


@query("ramp_pattern", "SELECT i AS pos, i % 977 + 1 AS value FROM range(5000) t(i)")
def ramp_pattern(spark, sf_dir):
    return synthetic.ramp(spark, 5000)


@query("gaussian_outliers")
def gaussian_outliers(spark, sf_dir):
    """Spread of a seeded field inside and outside its outlier channels."""
    field = synthetic.channel_outliers(synthetic.gaussian(spark, "g", 512, 64, 7))
    return field.groupBy((F.col("channel") < 8).alias("outlier")).agg(F.count("*").alias("n"), F.round(F.stddev_samp("value"), 3).alias("std"))


@query("environment")
def environment(spark, sf_dir):
    return manifest.environment(spark)


@query("running_ratio_stream", f"WITH {TRIALS} SELECT cache, path, count(*) AS pairs, round(exp(avg(ln(compressed_s / raw_s))), 9) AS ratio FROM trials GROUP BY ALL")
def running_ratio_stream(spark, sf_dir):
    """The trial log written as JSON files, followed as a stream to its end."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    path = f"{base}/trials-{uuid.uuid4().hex}"
    trial_rows(spark, sf_dir).select("segment", "cache", "path", "pair", "raw_s", "compressed_s").write.json(f"{path}/log")
    name = f"ratio_{uuid.uuid4().hex}"
    stream.write_complete(stream.running_ratio(stream.read_trials(spark, f"{path}/log")), name, f"{path}/state").awaitTermination()
    return rounded(spark.table(name), 9, "ratio")

"""Corpus preparation: articles from marked-up lines, held-out lists, seen documents, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import short_hash, squeeze_spaces

#: Fixed value: a top-level heading is a line with one equals sign on either side of the title.
HEADING = r"(?m)^ *= ([^=\n]+?) = *$"


def split_headings(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, ord, title, body of every article in a text; what stands before the first heading is dropped."""
    titles = F.regexp_extract_all(text, F.lit(HEADING), F.lit(1))
    bodies = F.slice(F.split(text, HEADING, -1), F.lit(2), F.size(titles))
    rows = texts.select(doc, F.posexplode(F.arrays_zip(titles.alias("title"), bodies.alias("body"))).alias("ord", "a"))
    return rows.select(doc, "ord", F.trim("a.title").alias("title"), F.trim(F.regexp_replace("a.body", r"^\s+|\s+$", "")).alias("body"))


def long_articles(articles: DataFrame, least: int) -> DataFrame:
    return articles.where(F.length("body") >= least)


def plain_text(lines: DataFrame, key: str, order: str, text: str, most_short: int = 64) -> DataFrame:
    """Per key: the lines with more than most_short characters, in order, with an empty line between."""
    kept = lines.where(F.length(F.trim(text)) > most_short)
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return kept.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n\n").alias("text"))


def seen_documents(*sources: DataFrame) -> DataFrame:
    """Union of (title, body, split, used_by) merged by title: the first body's hash and split, all users."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    rows = rows.withColumn("body_hash", short_hash("body"))
    first = F.min(F.struct("ord", "body_hash", "split"))
    return rows.groupBy("title").agg(first.alias("first"), F.array_sort(F.collect_set("used_by")).alias("used_by")).select("title", F.col("first.body_hash").alias("body_hash"), F.col("first.split").alias("split"), "used_by")


def unseen(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """docs (title, body_hash) of which neither the title nor the body was seen: two anti-joins, so
    that each stays a hash join."""
    return docs.join(seen.select("title").distinct(), "title", "left_anti").join(seen.select("body_hash").distinct(), "body_hash", "left_anti")


def rejection_reason(in_seen_title: Column, in_seen_body: Column, n_chars: Column, n_tokens: Column, least_chars: int, least_tokens: int) -> Column:
    """Why a document is not held out: the first reason in order of cost; null if it is."""
    return F.when(n_chars < least_chars, "too_short").when(in_seen_title, "title_seen").when(in_seen_body, "body_seen").when(n_tokens < least_tokens, "too_few_tokens")


def classify(docs: DataFrame, seen: DataFrame, least_chars: int, least_tokens: int) -> DataFrame:
    """docs (doc, title, corpus_index, body, n_tokens) with body_hash, reason and repeat of an earlier body."""
    rows = docs.withColumn("body_hash", short_hash(squeeze_spaces("body"))).withColumn("n_chars", F.length("body"))
    titles = seen.select("title").distinct().withColumn("title_seen", F.lit(True))
    bodies = seen.select("body_hash").distinct().withColumn("body_seen", F.lit(True))
    rows = rows.join(titles, "title", "left").join(bodies, "body_hash", "left")
    reason = rejection_reason(F.coalesce("title_seen", F.lit(False)), F.coalesce("body_seen", F.lit(False)), F.col("n_chars"), F.col("n_tokens"), least_chars, least_tokens)
    rows = rows.withColumn("reason", reason).drop("title_seen", "body_seen")
    # only documents that pass every other test can stand first
    first = F.row_number().over(Window.partitionBy("body_hash", F.col("reason").isNull()).orderBy("corpus_index", "doc"))
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), "body_repeated").otherwise(F.col("reason")))


def freeze_held_out(classified: DataFrame, n: int) -> DataFrame:
    """The first n accepted documents in corpus order, numbered h00, h01, ... (n rows are ranked)."""
    kept = classified.where("reason IS NULL").orderBy("corpus_index", "doc").limit(n)
    number = F.row_number().over(Window.orderBy("corpus_index", "doc")) - 1
    return kept.select(F.format_string("h%02d", number).alias("held_id"), "doc", "title", "corpus_index", "n_chars", "body_hash")


def rejected(classified: DataFrame, held: DataFrame, n: int, most: int = 80) -> DataFrame:
    """The rejects scanned before the last acceptance of a full list, cut to `most`."""
    last = held.agg(F.when(F.count("*") >= n, F.max("corpus_index")).alias("last"))
    rows = classified.where("reason IS NOT NULL").crossJoin(F.broadcast(last))
    rows = rows.where(F.col("last").isNull() | (F.col("corpus_index") < F.col("last")))
    return rows.orderBy("corpus_index", "doc").limit(most).select("doc", "corpus_index", "reason")


def semi(docs: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return docs.join(keys.select(on).distinct(), on, "left_semi")


def missing(keys: DataFrame, docs: DataFrame, on: str) -> DataFrame:
    """Keys without a document."""
    return keys.select(on).distinct().join(docs.select(on).distinct(), on, "left_anti")


def require_count(rows: DataFrame, least: int, what: str) -> DataFrame:
    """rows, or an error when the query runs if there are fewer than least."""
    n = rows.agg(F.count("*").alias("count_n"))
    fine = F.when(F.col("count_n") >= least, F.lit(True)).otherwise(F.raise_error(F.lit(f"fewer than {least} {what}")).cast("boolean"))
    return rows.crossJoin(F.broadcast(n)).where(fine).drop("count_n")  # a filter, so that it is not pruned

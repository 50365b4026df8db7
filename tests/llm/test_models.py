"""Neighbours, classifiers and the pipeline: brute force and held-out accuracy."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import language, mix, neighbours, quality, tokens
from quillon.llm.decontaminate import find_leaks


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[ids == ids[q]] = np.inf
    at = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in at if np.isfinite(d[i])]


def test_neighbours_of_the_table(spark):
    """Recall against brute force, exact scores, ranks in order."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = neighbours.op2_neighbours(spark, sf).toPandas()
    hit = 0
    for q in np.flatnonzero(ids % 100 == 0):
        mine = got[got.query_id == ids[q]].sort_values("rank")
        want = brute(ids, x, q, 10)
        assert mine["rank"].tolist() == list(range(1, 11))
        assert list(zip(mine.score, mine.vec_id)) == sorted(zip(mine.score, mine.vec_id))
        exact = {i: s for i, s in brute(ids, x, q, len(ids))}
        assert np.allclose([exact[v] for v in mine.vec_id], mine.score, rtol=1e-12)
        hit += len({i for i, _ in want} & set(mine.vec_id))
    assert hit / (10 * (ids % 100 == 0).sum()) >= 0.9


def test_neighbours_with_bad_rows_ties_and_copies(spark):
    good = [(i, [float(i % 5), 1.0, 2.0]) for i in range(0, 700, 7)]
    bad = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [None, 1.0, 1.0]), (8, [1.0]), (None, [1.0, 1.0, 1.0]), (100, [9.0, 9.0]), (0, [0.0, 1.0, 2.0])]
    table = spark.createDataFrame([(*r, "x") for r in good + bad], "vec_id long, embedding array<float>, rank string")
    got = neighbours.nearest(table, lambda i: F.pmod(i, F.lit(100)) == 0).collect()
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    want = {int(ids[q]): brute(ids, x, q, 10) for q in np.flatnonzero(ids % 100 == 0)}
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == want


def test_neighbours_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    ask = lambda rows: neighbours.nearest(spark.createDataFrame(rows, schema), lambda i: F.pmod(i, F.lit(100)) == 0).collect()
    assert ask([]) == [] and ask([(0, [1.0])]) == []
    assert [(r["vec_id"], r["rank"], r["score"]) for r in ask([(0, [1.0]), (1, [3.0])])] == [(1, 1, 2.0)]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert all(h == (fold(i, 4) == 2) for i, h in got.held_out.items())
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").join(got)
    held = labels[labels.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", "x"), (2, None, "x"), (None, "", "x"), (4, "!!! " * 3000, "x")], "doc_id long, text string, quality_score string")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = quality.score(docs, none).collect()
    assert len(rows) == 4 and all(r["quality_score"] == 0.5 for r in rows)
    one = quality.train(docs, spark.createDataFrame([(1, 1), (1, 1), (4, 1), (4, None)], "doc_id long, quality int"))
    assert quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 4  # nothing to learn from: all stay
    assert one.prior is not None and quality.score(docs.limit(0), one).count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert np.array_equal(a.w1, b.w1) and a.temperature == b.temperature


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op10_language(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all(h == (fold(i, 5) == 0) for i, h in got.held_out.items())
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").join(got)
    held = truth[truth.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * (1 + i % 4), "de" if i % 2 else "en") for i in range(60)] + [(100, None, "en"), (101, "", "en"), (102, "123 !!! …", None), (103, "é" * 300000, None), (None, "the cat", "xx")], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.names == ["de", "en"]
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert {got[i]["lang_pred"] for i in (100, 101, 102)} == {"und"} and got[103]["lang_pred"] in ("de", "en") and got[None]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(60))
    empty = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}


def test_long_texts_are_scored_in_pieces_as_whole(monkeypatch):
    model = language.LanguageModel(["a", "b"], np.random.default_rng(0).normal(size=(language.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    data = np.frombuffer(("some words and more, " * 400).encode(), np.uint8)
    offsets = np.array([0, 5000, len(data)])
    whole = language.mean_rows(data, offsets, model.weights)
    monkeypatch.setattr(language, "PIECE", 2048)
    assert np.allclose(language.mean_rows(data, offsets, model.weights), whole, rtol=0.05, atol=0.02)


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, sf), "test")
        out.append(docs)
    return sf, out


def test_pipeline_stages(spark, stages):
    sf, (good, one, clean, mixed, file) = stages
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(d.columns == columns for d in (good, one, clean, mixed)) and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    assert good.count() >= one.count() >= clean.count() > 0
    assert find_leaks(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).where("size(hit_spans) > 0").count() == 0
    words = lambda d: d.select(F.sum(F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(mixed) - words(clean)) < 0.2 * words(clean)
    assert file.count() == mixed.count() and set(file.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    starts = file.orderBy("start").collect()
    assert starts[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(starts, starts[1:]))


def test_pipeline_keeps_labelled_good_documents(spark, stages):
    sf, (good, *_) = stages
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r[0] for r in good.select("doc_id").collect()}
    fine = [r["doc_id"] for r in labels.collect() if r["quality"] == 1]
    assert np.mean([i in kept for i in fine]) > 0.9


def test_operators_share_no_module_state():
    assert mix.SEED and tokens.END_ID == 2


def plain_slots(text):
    """(slot of each word, slot of its shape) of one text, by loops over its bytes."""
    data, out = (text or "").encode(), ([], [])
    for word in re.findall(rb"[^\x20\x09-\x0D]+", data):
        one = np.frombuffer(word, np.uint8)
        for slots, found in zip(out, quality.token_slots(one, np.array([0, len(one)]))):
            slots.append(int(found[0]))
    return out


def plain_contexts(texts):
    index, out = quality.index_vectors(), np.zeros((quality.SLOTS, quality.DIM))
    for text in texts:
        for slots in plain_slots(text):
            for i, slot in enumerate(slots):
                for j in range(max(0, i - quality.REACH), min(len(slots), i + quality.REACH + 1)):
                    if j != i:
                        out[slot] += index[slots[j]]
    return (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def test_contexts_are_summed_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "CONTEXT_WORDS", 5)
    texts = ["The cat saw 12 dogs. The cat ran!", None, "", "one", "The cat saw 12 dogs. The cat ran!", "é é é " * 40, "a b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = plain_contexts(texts)
    for parts, flush in ((1, 1 << 26), (4, 1 << 26), (2, 7)):
        monkeypatch.setattr(quality, "FLUSH_WORDS", flush)
        assert np.array_equal(quality._context_table(docs.repartition(parts), "text"), want)
    few = quality.train(docs, spark.createDataFrame([(3, 1), (6, 0)], "doc_id long, quality int"))
    assert np.array_equal(few.context, want)  # words of rows without a label have contexts too
    assert not quality._context_table(docs.limit(0), "text").any()


def test_quality_scores_row_by_row(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.union(docs.limit(3))  # repeated rows
    model = quality.train(docs, labels)
    index, context, d = quality.index_vectors().astype(float), model.context.astype(float) * 2, quality.DIM
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    for row in docs.collect():
        both = plain_slots(row["text"])
        x, norms = [], []
        for slots in both:
            for table in (index, context):
                mean = sum((table[s] for s in slots), np.zeros(d)) / max(len(slots), 1)
                x.extend(mean)
                norms.append(np.sqrt((mean * mean).sum()))
        x = np.array([*x, *norms, np.log(1 + len(both[0])) / 5])
        hidden = [max(0.0, v) for v in ((x - model.mean) / model.scale) @ model.w1 + model.b1]
        low, high = (np.array(hidden) @ model.w2 + model.b2) / model.temperature
        assert abs(got[row["doc_id"]] - 1 / (1 + np.exp(low - high))) < 1e-4

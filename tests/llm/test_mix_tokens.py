"""Mixing, token files and separator scans against brute force."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import mix, separators, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGE = [None, "", " ", "Hello, world. 3.14!", "a<|endoftext|>b", "É é ß İ ΑΣ ﬁ ½ 日本 한국", "it's don't", "x" * 5000, "word " * 3000, "same text", "same text"]


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, f"s{i % 3}" if i % 5 else None, "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_targets_share_all_words_and_stop_at_three_times():
    got = mix.source_targets([("b", 100), (None, 1000), ("a", 10), ("c", 0)])
    assert [g[0] for g in got] == ["a", "b", "c", None]
    assert sum(g[2] for g in got) == pytest.approx(1110)
    assert all(t <= 3 * n + 1e-9 for _, n, t in got) and got[0][2] == 30 and got[2][2] == 0


def test_splitting_tree_keeps_quotas():
    out = mix.split_quotas(np.array([1000, 10, 0, 333]), 7, 1)
    assert out.sum(axis=0).tolist() == [1000, 10, 0, 333] and np.ptp(out.sum(axis=1)) <= 3
    assert (out == mix.split_quotas(np.array([1000, 10, 0, 333]), 7, 1)).all()


def test_mix_is_near_its_targets_and_repeats(spark, sf):
    a = mix.op1_mix(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    size = docs["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert (a.set_index("doc_id")["size"] == size.sort_index()).all()
    assert (a["taken"] <= 3 * a["size"]).all() and (a["taken"] % a["size"].clip(lower=1) == 0).all()
    by = a.assign(source=a.doc_id.map(docs["source"])).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), biggest=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.biggest).all()
    want = {s: t for s, _, t in mix.source_targets(list(by["size"].items()))}
    assert all(abs(want[s] - t) < 1e-6 for s, t in by.target.items())
    assert a.equals(mix.op1_mix(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True))


def test_mix_rows_are_whole_copies_in_shards(spark):
    docs = docs_of(spark, [f"w{i} " * (1 + i % 7) for i in range(300)] + EDGE)
    rows = mix.mix(docs, shards=4)
    assert set(rows.columns) == {*docs.columns, "mix_shard"} and {r[0] for r in rows.select("mix_shard").distinct().collect()} <= set(range(4))
    assert rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mix.mix(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 64))
def test_blocks_round_trip(ids, size):
    x = np.array(ids, np.uint32)
    packed = tokens.pack_ids(x, size)
    assert (tokens.unpack_ids(packed, block_ids=size) == x).all()
    a, b = len(x) // 3, len(x) - len(x) // 4
    assert (tokens.unpack_ids(packed, a, b, size) == x[a:b]).all()


def test_outliers_do_not_widen_a_block():
    x = np.full(4096, 7, np.uint32)
    x[::200] = 4_000_000_000
    assert len(tokens.pack_ids(x)) < 200


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBéÉ'sßİΣ.,!-_1½ \n\t<|>endoftxʼ한́")), max_size=40))
def test_encoder_equals_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids + [2]
    ids, n = ENCODER.encode([text.encode()])
    assert ids.tolist() == want and n.tolist() == [len(want)]


LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tokens.WordEncoder(PATH, 2)


def test_token_file_round_trip(spark, tmp_path):
    ids = [5, 3, 3, None, 9, 1, 0, 2, 8, 7, 7]
    docs = docs_of(spark, EDGE, ids)
    tokens.write_tokens(docs, str(tmp_path / "t"), PATH)
    rows = sorted(tokens.read_tokens(spark, str(tmp_path / "t"), ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    want = sorted(LIBRARY.encode(t or "", add_special_tokens=False).ids + [2] for t in EDGE)
    assert sorted(r["ids"] for r in rows) == want
    tokens.write_tokens(docs.limit(0), str(tmp_path / "none"), PATH)
    assert tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("block_ids", [1, 3, 50, 1 << 20])
def test_separator_scan_stitches_blocks(spark, block_ids, monkeypatch):
    monkeypatch.setattr(separators, "RUN", 4)
    texts = [t for t in EDGE if t is None or len(t) < 100]
    blocks = separators.flat_blocks(docs_of(spark, texts).coalesce(1), PATH, block_ids=block_ids)
    rows = sorted(separators.count_tokens(blocks).collect(), key=lambda r: r["ordinal"])
    want = [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r["n_tokens"] for r in rows] == want and all(r["terminated"] for r in rows)
    assert [r["start"] for r in rows] == (np.cumsum([0, *want[:-1]]) + np.arange(len(want))).tolist()


def test_separator_scan_of_raw_files(spark, tmp_path):
    np.array([9, 9, separators.SEPARATOR, separators.SEPARATOR, 4], "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    rows = sorted(separators.count_tokens(separators.flat_files(spark, str(tmp_path), block_ids=2)).collect(), key=lambda r: r["ordinal"])
    assert [(r["n_tokens"], r["terminated"]) for r in rows] == [(2, True), (0, True), (1, False)]


def test_token_counts_query(spark, sf):
    got = {r["doc_id"]: r["n_tokens"] for r in separators.op9_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r["doc_id"]: len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs}

"""Every registered query against its SQL on the smallest tables, and the driver's entry points."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return a == b


def check(rows, columns, relation):
    assert sorted(columns) == sorted(relation.columns)
    order = [columns.index(c) for c in sorted(columns)]
    other = [relation.columns.index(c) for c in sorted(columns)]
    key = lambda r: [("" if v is None else repr(v)) for v in r]
    a = sorted(([r[i] for i in order] for r in rows), key=key)
    b = sorted(([r[i] for i in other] for r in relation.fetchall()), key=key)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        check(rows, df.columns, duck.sql(registry.ORACLES[name]))
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for path in (root / "quillon").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path

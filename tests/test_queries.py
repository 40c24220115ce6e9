"""Every registered query against its DuckDB twin; queries without one must return rows."""
from __future__ import annotations

import math

import duckdb
import pytest

from landloom.plans import registry
from landloom.plans.views import TABLES

registry.load_all()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(v) for v in r) for r in df.select(*cols).collect())
    if name not in registry.ORACLES:
        assert got
        return
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall())
    assert got == want


def test_oracles_have_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)

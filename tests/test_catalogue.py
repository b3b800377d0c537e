"""Every registered query with SQL equals DuckDB on the smallest tables; the entry points hold their contract."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations client_changes".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in ORACLE:
        assert got
        return
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in got) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

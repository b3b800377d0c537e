"""The registered queries that SQL can express equal DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from cairn.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([r[names.index(c)] for c in df.columns]) for r in cursor.fetchall())
    assert sorted(str(list(r)) for r in df.collect()) == want

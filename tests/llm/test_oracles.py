"""Queries with DuckDB SQL against it, over the whole smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from finlens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    df = QUERIES[name](spark, small_dir)
    rel = con.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(cols)
    got = Counter(tuple(r[c] for c in sorted(cols)) for r in df.collect())
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    assert got == Counter(tuple(r[i] for i in order) for r in rel.fetchall())

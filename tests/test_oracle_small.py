"""Every registered query against its DuckDB oracle on the smallest tables,
plus structural checks of the driver contract."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from finlens.plans import all_queries
from tests.conftest import SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMALL, t + '.parquet')}')")
    return c


def test_contract_shapes():
    q, sql = entry.queries(), entry.oracle_sql()
    assert len(q) >= 60 and set(sql) <= set(q)
    assert set(all_queries()) <= set(q)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "exposure_band" in df.columns


@pytest.mark.parametrize("name", sorted(n for n, q in all_queries().items() if q.oracle))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(entry.oracle_sql()[name])
    want = _canon([d[0] for d in rel.description], rel.fetchall())
    assert got == want


def test_no_cartesian_nested_loop_or_python_eval(spark):
    sys_path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools")
    import sys

    sys.path.insert(0, sys_path)
    from plan_audit import FORBIDDEN, audit

    bad = {q: {k: c[k] for k in FORBIDDEN if c[k]} for q, c in audit(spark, SMALL).items()}
    assert not {q: v for q, v in bad.items() if v}

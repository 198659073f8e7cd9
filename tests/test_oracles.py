"""Every query with SQL against DuckDB over the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from wayfold.plans import registry

TABLES = Path("/root/testdata/sf0.001")
SQL = registry.oracle_sql()


def _plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, int):
        return float(v)
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if math.isnan(f) else f + 0.0


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(TABLES))
    cols = sorted(got.columns)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    key = lambda r: [(x is None, str(x)) for x in r]
    a = sorted(([_plain(r[c]) for c in cols] for r in got.collect()), key=key)
    b = sorted(([_plain(r[i]) for i in at] for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-6)), (x, y)


def test_a_wrong_oracle_shows(spark, duck):
    got = {tuple(r) for r in registry.queries()["question_bank"](spark, str(TABLES)).collect()}
    wrong = set(duck.execute(SQL["question_bank"].replace("min(", "max(")).fetchall())
    assert got != wrong

"""Every query against its SQL in DuckDB, to the six decimals that queries give."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tonegrid.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    if isinstance(v, (int, float)) and not math.isnan(v):
        return f"{float(v) + 0.0:.6f}".replace("-0.000000", "0.000000")
    return repr(v) if not isinstance(v, float) else "None"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0

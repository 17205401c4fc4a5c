"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyloom.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def same(a, b) -> bool:
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    if a is None or b is None or isinstance(a, str) or isinstance(b, str):
        return a == b
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-6)
    except (TypeError, ValueError):
        return str(a) == str(b)


def order(row):
    return [(v is None, str(v) if not isinstance(v, (int, float)) else f"{round(float(v), 3) + 0.0:020.3f}") for v in row]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    mine = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(mine.columns)
    theirs = duck.execute(registry.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(theirs.description)}
    assert sorted(at) == columns
    want = sorted(([row[at[c]] for c in columns] for row in theirs.fetchall()), key=order)
    got = sorted((list(r) for r in mine.select(*columns).collect()), key=order)
    assert len(got) == len(want)
    assert all(map(same, got, want))

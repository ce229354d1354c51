"""Every market query equals its DuckDB twin at the smallest scale."""

import os

import duckdb
import pytest

from tapewright.plans import archive_queries, file_queries, store_queries, queries as market_queries  # noqa: F401  they register themselves
from tapewright.plans.registry import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace(" ", "T")
    if hasattr(v, "quantize"):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_duckdb(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    cur = duck.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    assert got == want

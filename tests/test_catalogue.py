"""Every query with SQL against DuckDB."""

import os

import duckdb
import pytest

from quillmesh.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings events".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.5f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        at = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall())
    got = sorted([plain(r[c]) for c in sorted(names)] for r in df.collect())
    assert got == want


def test_the_rest_runs(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, SF).count() > 0

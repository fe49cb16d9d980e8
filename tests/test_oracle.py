"""Every registered query against its SQL in DuckDB, row by row."""

import math
import os

import duckdb
import pytest

from kartwerk import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    q = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in q.description]
    want = sorted(tuple(_plain(dict(zip(names, r))[c]) for c in cols) for r in q.fetchall())
    assert sorted(names) == cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0

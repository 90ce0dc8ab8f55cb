"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import suite

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in suite.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, sql, name):
    df = suite.QUERIES[name](spark, str(DATA))
    got = df.toArrow().to_pylist()
    if name not in suite.ORACLE_SQL:
        assert got and df.columns
        return
    r = sql.execute(suite.ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([plain(v) for _, v in sorted(zip(cols, x))]) for x in r.fetchall())
    assert sorted(repr([plain(x[c]) for c in sorted(cols)]) for x in got) == want


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) >= set(suite.QUERIES)
    assert e.entry(spark).columns == ["n_name", "customers"]

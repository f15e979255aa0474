"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidemark import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations region nation customer supplier part orders lineitem events"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()))
    if name not in Q.oracle_sql():
        assert got
        return
    found = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())

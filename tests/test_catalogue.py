"""Every registered query of the library runs; those with SQL give the same rows on DuckDB."""

import os

import duckdb
import pytest

from glowtrace.plans.catalogue import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows, columns):
    def cell(v):
        if v is None or v != v:
            return "NULL"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert plain(rows, sorted(names)) == plain([dict(zip(names, r, strict=True)) for r in want.fetchall()], sorted(names))

"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import math
import os

import duckdb
import pytest

from cairnlake.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in ORACLE_SQL:
        return
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_flagship(spark):
    assert FLAGSHIP(spark, SF).count() > 0


def test_sql_names_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)

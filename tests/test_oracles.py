"""Every query with an oracle gives the rows of its SQL in DuckDB; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ONLY = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.5f}"
    return str(value)


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", ONLY)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = [df.columns.index(c) for c in sorted(columns)]
    other = [columns.index(c) for c in sorted(columns)]
    mine = sorted(tuple(_plain(r[i]) for i in order) for r in got)
    theirs = sorted(tuple(_plain(r[i]) for i in other) for r in want.fetchall())
    assert mine == theirs

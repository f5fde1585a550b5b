"""Every query with SQL gives the same rows as another engine does, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from netquarry import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.FOUND))
def test_same_rows_as_sql(spark, other, name):
    found = queries.FOUND[name](spark, DATA)
    wanted = other.sql(queries.SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert table(found.columns, found.collect()) == table(wanted.columns, wanted.fetchall())

"""Every registered query against its check SQL, and the driver contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from yushi.check_sql import checks
from yushi.plans.catalog import QUERIES

NAMES = sorted(QUERIES)


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_all_queries_have_check_sql():
    assert set(QUERIES) == set(checks())
    assert set(QUERIES) <= set(entry.queries()) and set(checks()) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rate_min" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == table(names, cur.fetchall())

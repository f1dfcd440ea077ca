"""Registered queries of the subpackage against their check SQL, and what is registered."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from yushi.llm import tables
from yushi.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=str)


def test_registered():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) and "pipeline" in entry.queries()
    assert len(corpus_pipeline.STAGES) == 5


def test_mix_needs_no_python_tasks(spark, monkeypatch):
    def sent(spark):
        raise AssertionError("op4 runs a Python task")

    monkeypatch.setattr(tables, "ready", sent)
    assert QUERIES["op4_mix_sources"](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == table(names, cur.fetchall())

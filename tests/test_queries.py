"""Every query with SQL against DuckDB on the smallest tables."""

import importlib.util
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LLM = importlib.util.find_spec("dossierspark.llm") is not None
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def rows(frame):
    """Sorted rows as text; whole floats as integers, nulls alike."""

    def text(v):
        if not isinstance(v, (list, bool)) and pd.isna(v):
            return ""
        if isinstance(v, float) and v.is_integer():
            return str(int(v))
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in OWN if n in ORACLES])
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in OWN if n not in ORACLES])
def test_runs(spark, name):
    n = QUERIES[name](spark, SF).count()
    assert n > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_catalogue():
    assert set(ORACLES) <= set(QUERIES)
    if LLM:
        assert sum(n.startswith("op") and n[2].isdigit() for n in QUERIES) == 13 and "pipeline" in QUERIES

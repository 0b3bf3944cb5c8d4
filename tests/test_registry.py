"""Every registered core query with SQL gives the rows that the SQL gives, on the smallest data set."""

import math
import os
from pathlib import Path

import pytest

from keepsake.plans import registry

DATA = os.environ.get("KEEPSAKE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test data here")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.5g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def lines(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    data = got.collect()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert lines(got.columns, data) == lines(want.columns, want.fetchall())
    else:
        assert data


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())

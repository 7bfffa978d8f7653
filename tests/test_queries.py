"""Every registered query runs on the smallest tables and agrees with its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")
    return str(v)


NAMES = [k for k in __spark_entry__.queries() if not k.startswith("op") and k != "pipeline"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = __spark_entry__.queries()[name](spark, SF)
    rows = got.collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        cols = sorted(got.columns)
        want = con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert sorted(tuple(map(plain, r)) for r in want) == sorted(tuple(plain(r[c]) for c in cols) for r in rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["src_a", "src_b", "id_a", "id_b", "confidence"]

"""Every query with SQL gives that SQL's rows."""

import math
import os

import duckdb
import pytest

from tidewarden.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in os.listdir(small):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{small}/{t}'")
    return con


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    cell = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else str(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    got = duck.execute(registry.ORACLE[name])
    cols = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(got.fetchall(), cols)


@pytest.mark.parametrize("name", ["coastline_way_reasons", "polygon_build", "catchup_plan", "stream_incremental_issues"])
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

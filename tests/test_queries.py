"""Every registered query that has SQL gives the rows DuckDB gives."""

import glob
import os

import duckdb
import pytest

from tokenloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(repr(tuple(r)) for r in got.select(*order).collect()) == sorted(repr(r) for r in want.project(", ".join(f'"{c}"' for c in order)).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

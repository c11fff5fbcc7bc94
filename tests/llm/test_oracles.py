"""Every corpus query that has SQL gives the rows DuckDB gives."""

import glob
import os

import duckdb
import pytest
from tokenloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(repr(tuple(r)) for r in got.select(*order).collect()) == sorted(repr(r) for r in want.project(", ".join(f'"{c}"' for c in order)).fetchall())

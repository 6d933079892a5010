"""Every registered query of the core against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from voxelmill.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(rows):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    return sorted((tuple(float(v) if number(v) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query(spark, db, name):
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = db.sql(core.SQL[name])
    assert cols == sorted(found.columns)
    listed = ", ".join(f'"{c}"' for c in cols)
    want = db.sql(f"select {listed} from found").fetchall()
    assert canonical(map(tuple, df.select(*cols).collect())) == canonical(want)

"""Queries against their SQL where tables are larger: volumes in several tasks, counts beyond half floats."""

import glob
import os

import duckdb

from voxelmill.functions import tables
from voxelmill.plans import queries as core

SF = "/root/testdata/sf0.001"


def differences(df, name, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"select {cols} from ({core.SQL[name]})").fetchall()
    got = list(map(tuple, df.collect()))
    return sorted(set(got) ^ set(want), key=str), len(got) - len(want)


def test_boxes_in_sql_of_volumes_in_several_tasks(spark, monkeypatch):
    """Where Spark turns the join below PARTITION BY into a broadcast, voxel_box gets a volume's rows in parts; here every tenth row ends one."""

    class Parts(tables.VoxelBox):
        def eval(self, row):
            super().eval(row)
            if self.n == 10:
                yield from self.terminate()
                self.__init__()

    monkeypatch.setattr(tables, "VoxelBox", Parts)
    name = "geo15_patches_in_sql"
    assert differences(core.QUERIES[name](spark, SF), name, SF) == ([], 0)
    monkeypatch.undo()
    tables.register(spark)


def test_half_floats_of_counts_on_both_sides_of_2048(spark, tmp_path):
    """(x, y, z) of the cells and their counts; the first channel has none that half floats hold, the second has the largest that they all hold."""
    cells = [(1, 2, 3, 3000), (2, 2, 3, 2049), (3, 4, 9, 2048), (4, 4, 15, 5), (5, 5, 8, 70000)]
    rows = " union all ".join(f"select {x} as l_partkey, {y} as l_suppkey, {z} as l_orderkey from range({n})" for x, y, z, n in cells)
    duckdb.sql(f"copy (select *, 1.0::double as l_quantity from ({rows})) to '{tmp_path}/lineitem.parquet' (format parquet)")
    name = "src8_packed_half_floats"
    df = core.QUERIES[name](spark, str(tmp_path))
    assert differences(df, name, tmp_path) == ([], 0)
    assert sorted(r.t for r in df.collect()) == [5, 2048]

"""The data sources: what filters leave to open, and what commits, failures and damaged files leave behind."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import connect
from voxelmill.sources import formats, nifti, pack


@pytest.fixture(scope="module")
def registered(spark):
    formats.register(spark)
    return spark


def volumes(spark, names=("a", "b", "c"), dims=(3, 4, 5)):
    rng = np.random.default_rng(2)
    rows = [(n, *map(int, p), float(rng.integers(0, 9))) for n in names for p in np.ndindex(dims)]
    return spark.createDataFrame(rows, "volume_id string, x int, y int, z int, value double"), rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("compress", ["true", "false"])
def test_volumes_there_and_back(registered, tmp_path, compress):
    df, rows = volumes(registered)
    formats.save_volumes(df, str(tmp_path), (3, 4, 5), np.diag([2.0, 2, 2, 1]), compress=compress)
    read = registered.read.format("voxel-nifti").option("bytes", 2 * 12 * 4).load(str(tmp_path))
    assert sorted((r.volume_id, r.x, r.y, r.z, r.value) for r in read.collect()) == sorted(rows)
    assert all(r.vid == r.x + 3 * (r.y + 4 * r.z) for r in read.collect())
    one = read.where("volume_id in ('b', 'x') and z > 1 and z < 4")
    assert "Filter (" not in plan(one) and one.rdd.getNumPartitions() == 1
    assert sorted((r.volume_id, r.x, r.y, r.z, r.value) for r in one.collect()) == sorted(r for r in rows if r[0] == "b" and 1 < r[3] < 4)
    assert read.rdd.getNumPartitions() == (3 if compress == "true" else 9)
    assert read.where("volume_id = 'none'").count() == 0 and read.where("value > 5 and x = 1").count() == sum(r[4] > 5 and r[1] == 1 for r in rows)
    assert np.allclose(np.array(nifti.read_meta(registered, str(tmp_path)).first().affine), np.diag([2.0, 2, 2, 1]))


def test_pack_there_and_back(registered, tmp_path):
    maps, _ = volumes(registered, range(1, 11), (2, 3, 2))
    maps = maps.select(F.col("volume_id").cast("int").alias("channel"), "x", "y", "z", F.col("value").alias("t"))
    formats.save_pack(maps, str(tmp_path), (2, 3, 2), 4)
    index = json.loads((tmp_path / "index.json").read_text())
    assert index["shape"] == [10, 2, 3, 2] and [s["channelLabels"] for s in index["shards"]] == [["1", "2", "3", "4"], ["5", "6", "7", "8"], ["9", "10"]]
    read = registered.read.format("voxel-pack").load(str(tmp_path))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, maps.collect()))
    some = read.where("channel >= 4 and channel <= 5")
    assert "Filter (" not in plan(some) and some.rdd.getNumPartitions() == 2 and some.count() == 24
    assert read.where("channel = 77").count() == 0
    shard = tmp_path / index["shards"][0]["filename"]
    shard.write_bytes(shard.read_bytes()[:-1] + b"\x01")
    assert read.where("channel = 9").count() == 12
    with pytest.raises(Exception, match="differs from the index's checksum"):
        read.where("channel = 2").count()


def test_failures_leave_nothing(registered, tmp_path):
    df, rows = volumes(registered)
    path = str(tmp_path / "v")
    wrong = df.withColumn("x", F.when((F.col("volume_id") == "c") & (F.col("z") == 4), 99).otherwise(F.col("x")))
    with pytest.raises(Exception, match="out of bounds"):
        formats.save_volumes(wrong, path, (3, 4, 5))
    assert not [f for f in os.listdir(path) if not f.startswith(".")]
    formats.save_volumes(df, path, (3, 4, 5))
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="out of bounds"):
        formats.save_volumes(wrong, path, (3, 4, 5))
    assert sorted(os.listdir(path)) == before
    assert registered.read.format("voxel-nifti").load(path).count() == len(rows)
    # A file that no commit lists, as a lost task may leave it, is not read.
    (tmp_path / "v" / "a-lost.nii").write_bytes(b"torn")
    more, extra = volumes(registered, ("d",))
    formats.save_volumes(more, path, (3, 4, 5), mode="append")
    assert registered.read.format("voxel-nifti").load(path).count() == len(rows) + len(extra)
    formats.save_volumes(more, path + "2", (3, 4, 5))
    with pytest.raises(Exception, match="several tasks wrote"):
        scattered = more.select("volume_id", "x", "y", "z", "value").repartition(4)
        scattered.write.format("voxel-nifti").mode("append").option("dims", "3x4x5").save(path + "2")
    assert registered.read.format("voxel-nifti").load(path + "2").count() == len(extra)


def test_shards_without_weight_are_pruned(spark, tmp_path):
    rows = [(c, v, float(c * v)) for c in range(1, 13) for v in range(5)]
    pack.write_pack(spark.createDataFrame(rows, "channel int, vid int, t double"), str(tmp_path), 3)
    w = {2: 0.5, 7: 0.0, 12: 2.0}
    weights = spark.createDataFrame(list(w.items()), "channel int, w double")
    out = connect.weighted_sum_of_shards(spark, str(tmp_path), weights, 3)
    assert "dynamicpruning" in plan(out).lower()
    assert {r.vid: r.value for r in out.collect()} == {v: sum(w.get(c, 0) * c * v for c in range(1, 13)) for v in range(5)}

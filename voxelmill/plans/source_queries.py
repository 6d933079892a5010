"""Queries over the data sources and the writers that commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connect
from ..session import new_folder
from ..sources import formats, nifti, pack
from . import substrate as S
from .queries import _WEIGHTS, _weights
from .registry import query
from .substrate import DIMS, GRIDS, PACK, VOL, micro
from .substrate import micro_sql as M


@query(f"WITH {VOL}, g AS (SELECT CAST(range AS INT) AS vid FROM range(4096)) SELECT CAST(g.vid AS BIGINT) AS vid, 0.5::DOUBLE * coalesce(value, 0) - 3 AS value FROM g LEFT JOIN vol USING (vid) WHERE g.vid // 256 BETWEEN 4 AND 11")
def src2_scaled_slices(spark, sf):
    """SRC-2, SRC-17: slices 4 to 11 of an uncompressed file, read by tasks of three slices each, with the header's slope and intercept applied."""
    formats.register(spark)
    folder = new_folder(spark, "scaled")
    nifti.write_files(nifti.to_files(S.volume(spark, sf), DIMS, compress=False, scale=(0.5, -3.0)), folder, ".nii")
    read = spark.read.format("voxel-nifti").option("scaled", True).option("bytes", 3 * 256 * 4).load(folder)
    return read.where(F.col("z").between(4, 11)).select("vid", "value")


@query(f"WITH {GRIDS} SELECT volume_id, CAST(x AS INT) AS x, y, z, value FROM gv WHERE volume_id = 'N-0' AND z >= 3")
def snk1_committed_volumes(spark, sf):
    """SNK-1, SNK-2: volumes written by a job that commits, of which one is asked for and opened."""
    formats.register(spark)
    folder = new_folder(spark, "volumes")
    formats.save_volumes(S.grid_volumes(spark, sf), folder, (14, 12, 10))
    read = spark.read.format("voxel-nifti").option("nonzero", True).load(folder)
    return read.where("volume_id = 'N-0' and z >= 3").select("volume_id", "x", "y", "z", "value")


_PACKED = "SELECT channel + 1 AS channel, vid // 16 AS x, vid // 4 % 4 AS y, vid % 4 AS z, t FROM pack"


def _maps(spark, sf):
    """The stand-in pack by voxel, with values that half floats hold exactly."""
    t = F.floor(F.col("t") * 1000) / 8
    at = [F.floor(F.col("vid") / 16).cast("int").alias("x"), (F.floor(F.col("vid") / 4) % 4).cast("int").alias("y"), (F.col("vid") % 4).cast("int").alias("z")]
    return S.pack(spark, sf).select((F.col("channel") + 1).cast("int").alias("channel"), *at, t.alias("t"))


@query(f"WITH {PACK}, m AS ({_PACKED}) SELECT CAST(channel AS INT) AS channel, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, CAST(floor(t * 1000) AS BIGINT) AS t FROM m WHERE channel IN (2, 3, 9)")
def snk8_committed_pack(spark, sf):
    """SNK-8, SRC-6: shards of three channels with an index of checksums, of which two are asked for and verified."""
    formats.register(spark)
    folder = new_folder(spark, "pack")
    formats.save_pack(_maps(spark, sf), folder, (4, 4, 4), 3)
    read = spark.read.format("voxel-pack").load(folder).where("channel in (2, 3, 9)")
    return read.select("channel", "x", "y", "z", F.round(F.col("t") * 8).cast("long").alias("t"))


@query(f"WITH {PACK} SELECT CAST(count(*) AS BIGINT) AS voxels, CAST(sum(CAST(floor(t * 1000) AS BIGINT)) AS BIGINT) AS total FROM pack")
def src6_whole_pack(spark, sf):
    """SRC-6: every shard of the pack."""
    formats.register(spark)
    folder = new_folder(spark, "pack")
    formats.save_pack(_maps(spark, sf), folder, (4, 4, 4), 4)
    read = spark.read.format("voxel-pack").load(folder)
    return read.agg(F.count(F.lit(1)).alias("voxels"), F.sum(F.round(F.col("t") * 8).cast("long")).alias("total"))


@query(f"{_WEIGHTS} SELECT vid, {M('value')} AS value FROM total_map")
def agg4_pruned_shards(spark, sf):
    """AGG-4, JN-6, JN-7: the weighted sum over a pack in shards of two channels; shards without weight aren't read."""
    folder = new_folder(spark, "pack")
    shifted = S.pack(spark, sf).withColumn("channel", F.col("channel") + 1)
    pack.write_pack(shifted, folder, 2)
    weights = _weights(spark, sf).withColumn("channel", F.col("channel") + 1)
    out = connect.weighted_sum_of_shards(spark, folder, weights, 2)
    return out.select(F.col("vid").cast("long").alias("vid"), micro(F.col("value")).alias("value"))

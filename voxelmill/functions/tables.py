"""Table functions for SQL: voxel_box and voxel_patches. ``register`` makes them known to a session."""

from __future__ import annotations

from itertools import product

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.geometry import patch_starts


class VoxelBox:
    """voxel_box(TABLE(volume_id, x, y, z) PARTITION BY volume_id): one row for each run of a volume's rows. A partition is read row by row; only its ends are kept.

    Spark leaves out the shuffle of PARTITION BY where a join below has one, and may then turn that join into a broadcast and read its shuffle where
    it lies: a volume's rows are in several tasks then. So queries put the boxes of a volume together by GROUP BY, with sum, min and max.
    """

    def __init__(self):
        self.name, self.n, self.low, self.high = None, 0, [None] * 3, [None] * 3

    def eval(self, row):
        self.name, self.n = row["volume_id"], self.n + 1
        for k, c in enumerate("xyz"):
            v = row[c]
            self.low[k] = v if self.low[k] is None or v < self.low[k] else self.low[k]
            self.high[k] = v if self.high[k] is None or v > self.high[k] else self.high[k]

    def terminate(self):
        if self.n:
            yield self.name, self.n, *self.low, *(h + 1 for h in self.high)


class VoxelPatches:
    """voxel_patches(nx, ny, nz, size, overlap): the starts of the patches that cover a grid, in raster order."""

    def eval(self, nx: int, ny: int, nz: int, size: int, overlap: float):
        ax, ay, az = (patch_starts(n, size, float(overlap)) for n in (nx, ny, nz))
        for k, (z, y, x) in enumerate(product(az, ay, ax)):
            yield k, x, y, z


def register(spark: SparkSession) -> None:
    spark.udtf.register("voxel_box", udtf(VoxelBox, returnType="volume_id: string, n: long, x0: int, y0: int, z0: int, x1: int, y1: int, z1: int"))
    spark.udtf.register("voxel_patches", udtf(VoxelPatches, returnType="patch: int, px: int, py: int, pz: int"))

"""Grids, resampling and layout changes as computed keys and joins.

Volumes are (volume_id, x, y, z, value), sparse where zeros are left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import inverse, map_point, padded_dims
from .elementwise import binarise, clean_label, half_up

AT = ["volume_id", "x", "y", "z"]


def linear_id(dims, x="x", y="y", z="z") -> Column:
    nx, ny, _ = dims
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return c(x) + nx * (c(y) + ny * c(z))


def row_major_id(dims, x="x", y="y", z="z") -> Column:
    _, ny, nz = dims
    return (F.col(x) * ny + F.col(y)) * nz + F.col(z)


def grid(ids: DataFrame, dims) -> DataFrame:
    """All voxels of a grid for each volume_id, generated plane by plane."""
    nx, ny, nz = dims
    planes = ids.select("volume_id").distinct().select("volume_id", F.explode(F.sequence(F.lit(0), F.lit(nz - 1))).alias("z"))
    cells = planes.select("volume_id", "z", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("i"))
    return cells.select("volume_id", (F.col("i") % nx).alias("x"), F.floor(F.col("i") / nx).cast("int").alias("y"), "z")


def inside(dims, x: str, y: str, z: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).between(0, n - 1) for c, n in zip((x, y, z), dims, strict=True)))


def resample_nearest(volume: DataFrame, src_affine, dst_dims, dst_affine) -> DataFrame:
    """The destination grid with the nearest source values; 0 outside the source."""
    m = inverse(src_affine) @ np.asarray(dst_affine, float)
    at = [half_up(c).cast("int") for c in map_point(m, F.col("x"), F.col("y"), F.col("z"))]
    cells = grid(volume, dst_dims).withColumns(dict(zip(("sx", "sy", "sz"), at, strict=True)))
    source = volume.select("volume_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "value")
    out = cells.join(source, ["volume_id", "sx", "sy", "sz"], "left")
    return out.select(*AT, F.coalesce("value", F.lit(0)).alias("value"))


def _weigh(points: DataFrame, source: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Sums of corner weight times value. points: key, sx, sy, sz (fractional); corners that are missing count as 0."""
    axes = []
    for c in ("sx", "sy", "sz"):
        low, f = F.floor(c).cast("int"), F.col(c) - F.floor(c)
        axes.append(F.array(F.struct(low.alias("i"), (1 - f).alias("w")), F.struct((low + 1).alias("i"), f.alias("w"))))
    out = points
    for n, a in zip("xyz", axes, strict=True):
        out = out.withColumn(f"c{n}", F.explode(a)).where(F.col(f"c{n}.w") > 0)
    corner = out.select(*key, *(F.col(f"c{n}.i").alias(f"_{n}") for n in "xyz"), (F.col("cx.w") * F.col("cy.w") * F.col("cz.w")).alias("w"))
    src = source.select("volume_id", *(F.col(n).alias(f"_{n}") for n in "xyz"), *(F.col(v).alias(f"_{v}") for v in values))
    joined = corner.join(src, ["volume_id", "_x", "_y", "_z"], "left")
    return joined.groupBy(*key).agg(*(F.coalesce(F.sum(F.col("w") * F.col(f"_{v}")), F.lit(0.0)).alias(v) for v in values))


def resample_linear(volume: DataFrame, src_affine, dst_dims, dst_affine) -> DataFrame:
    """The destination grid with trilinear source values; corners outside count as 0."""
    m = inverse(src_affine) @ np.asarray(dst_affine, float)
    points = grid(volume, dst_dims).withColumns(dict(zip(("sx", "sy", "sz"), map_point(m, F.col("x"), F.col("y"), F.col("z")), strict=True)))
    return _weigh(points, volume, AT, ["value"])


def spaced_dims(dims, spacing, target) -> tuple[int, int, int]:
    return tuple(max(1, int(np.floor(n * s / t + 0.5))) for n, s, t in zip(dims, spacing, target, strict=True))


def resize_linear(volume: DataFrame, dims, new_dims, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Corner-aligned linear resize of dense volumes; edges are kept."""
    cells = grid(volume, new_dims)
    for c, n, m in zip("xyz", dims, new_dims, strict=True):
        cells = cells.withColumn(f"s{c}", F.col(c) * ((n - 1) / (m - 1)) if m > 1 else F.lit(0.0))
    return _weigh(cells, volume, AT, list(values))


def resample_spacing(volume: DataFrame, dims, spacing, target) -> DataFrame:
    return resize_linear(volume, dims, spaced_dims(dims, spacing, target))


def resize_labels(volume: DataFrame, dims, new_dims) -> DataFrame:
    """Labels at cell centres: source index floor((d + 0.5) n / m), clamped."""
    cells = grid(volume, new_dims)
    for c, n, m in zip("xyz", dims, new_dims, strict=True):
        cells = cells.withColumn(f"s{c}", F.least(F.lit(n - 1), F.floor((F.col(c) + 0.5) * (n / m))).cast("int"))
    source = volume.select("volume_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "value")
    return cells.join(source, ["volume_id", "sx", "sy", "sz"], "left").select(*AT, F.coalesce("value", F.lit(0)).alias("value"))


def shift(volume: DataFrame, offset) -> DataFrame:
    return volume.withColumns({c: (F.col(c) + int(o)).cast("int") for c, o in zip("xyz", offset, strict=True)})


def crop(volume: DataFrame, start, end) -> DataFrame:
    """The box [start, end) with coordinates counted from its corner."""
    within = reduce(lambda a, b: a & b, ((F.col(c) >= a) & (F.col(c) < b) for c, a, b in zip("xyz", start, end, strict=True)))
    return shift(volume.where(within), [-s for s in start])


def place_back(box: DataFrame, start, dims, fill: float = 0.0) -> DataFrame:
    """The whole grid with a cropped box put back and ``fill`` around it."""
    back = shift(box, start)
    return grid(box, dims).join(back.select(*AT, "value"), AT, "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def centre_offset(dims, new_dims) -> tuple[int, int, int]:
    return tuple((t - c) // 2 for c, t in zip(dims, new_dims, strict=True))


def centre_pad(volume: DataFrame, dims, new_dims) -> DataFrame:
    """Moves a volume to the centre of a larger (or smaller) grid; what falls outside goes."""
    moved = shift(volume, centre_offset(dims, new_dims))
    return moved.where(inside(new_dims, "x", "y", "z"))


def centre_unpad(volume: DataFrame, dims, new_dims) -> DataFrame:
    moved = shift(volume, [-o for o in centre_offset(dims, new_dims)])
    return moved.where(inside(dims, "x", "y", "z"))


def orient(volume: DataFrame, dims, perm, flip) -> DataFrame:
    """New axis k is old axis perm[k], counted backwards where flip[k]."""
    out = [(dims[p] - 1 - F.col("xyz"[p])) if f else F.col("xyz"[p]) for p, f in zip(perm, flip, strict=True)]
    return volume.withColumns(dict(zip("xyz", out, strict=True)))


def orient_back(volume: DataFrame, dims, perm, flip) -> DataFrame:
    """The inverse of orient; dims are those before it."""
    back = [perm.index(k) for k in range(3)]
    new_dims = [dims[p] for p in perm]
    return orient(volume, new_dims, back, [flip[b] for b in back])


def slice_range(volume: DataFrame, first: int, last: int, nz: int) -> DataFrame:
    """Slices first to last (clamped to the grid), renumbered from 0."""
    first, last = max(0, first), min(nz - 1, last)
    return shift(volume.where(F.col("z").between(first, last)), (0, 0, -first))


def slice_embed(part: DataFrame, first: int, part_dims, dims) -> DataFrame:
    """Slices put back at ``first`` of a grid of the same width and height; raises where the grids don't fit, slices beyond its ends go."""
    if tuple(part_dims[:2]) != tuple(dims[:2]):
        raise ValueError(f"slices of {tuple(part_dims[:2])} don't fit into {tuple(dims[:2])}")
    return shift(part, (0, 0, first)).where(inside(dims, "x", "y", "z"))


def zero_pad(volume: DataFrame, dims, patch) -> tuple[DataFrame, tuple[int, int, int]]:
    """The dense volume on a grid that patches fill, with zeros beyond its ends, and the new dims."""
    new_dims = padded_dims(dims, patch)
    return grid(volume, new_dims).join(volume.select(*AT, "value"), AT, "left").withColumn("value", F.coalesce("value", F.lit(0.0))), new_dims


def unpad(volume: DataFrame, dims) -> DataFrame:
    """What of a padded volume lies on its first grid."""
    return volume.where(inside(dims, "x", "y", "z"))


def patch_starts(n: int, patch: int, overlap: float) -> list[int]:
    """Starts along one axis; the last patch ends at the edge."""
    step = max(1, int(np.floor(patch * (1 - overlap) + 0.5)))
    count = max(1, -(-(n - patch) // step) + 1) if n > patch else 1
    return sorted({min(i * step, max(0, n - patch)) for i in range(count)})


def patch_positions(spark, dims, patch, overlap: float) -> DataFrame:
    """patch, px, py, pz in raster order."""
    ax, ay, az = (patch_starts(n, p, overlap) for n, p in zip(dims, patch, strict=True))
    rows = spark.range(len(ax) * len(ay) * len(az)).withColumnRenamed("id", "patch")
    pick = lambda v, k: F.get(F.array(*map(F.lit, v)), k.cast("int"))
    p, nx, ny = F.col("patch"), len(ax), len(ay)
    return rows.select("patch", pick(ax, p % nx).alias("px"), pick(ay, F.floor(p / nx) % ny).alias("py"), pick(az, F.floor(p / (nx * ny))).alias("pz"))


def _holds(c: str, p: int):
    return lambda s: (s <= F.col(c)) & (F.col(c) < s + p)


def patch_voxels(volume: DataFrame, dims, patch, overlap: float) -> DataFrame:
    """Each voxel in each patch that holds it: patch start (px, py, pz) and place in the patch (ix, iy, iz).

    The starts that hold a voxel are picked per axis from short literal lists, so there is no range join.
    """
    out = volume
    for c, n, p in zip("xyz", dims, patch, strict=True):
        starts = F.array(*map(F.lit, patch_starts(n, p, overlap)))
        out = out.withColumn(f"p{c}", F.explode(F.filter(starts, _holds(c, p))))
        out = out.withColumn(f"i{c}", F.col(c) - F.col(f"p{c}"))
    return out


def flip_patch(voxels: DataFrame, patch, axes) -> DataFrame:
    return voxels.withColumns({f"i{c}": patch[k] - 1 - F.col(f"i{c}") for k, c in enumerate("xyz") if k in axes})


def corners(dims, affine) -> np.ndarray:
    """World places of the grid's corners, from voxel 0 to the grid's size along each axis."""
    m = np.asarray(affine, float)
    box = np.array([[x, y, z, 1.0] for x in (0, dims[0]) for y in (0, dims[1]) for z in (0, dims[2])])
    return (box @ m.T)[:, :3]


def view_overlap(dims_a, affine_a, dims_b, affine_b) -> float:
    """Share of the second box that the first covers, both as bounding boxes in world space."""
    a, b = corners(dims_a, affine_a), corners(dims_b, affine_b)
    both = np.minimum(a.max(0), b.max(0)) - np.maximum(a.min(0), b.min(0))
    size = np.prod(b.max(0) - b.min(0))
    return float(np.prod(np.maximum(both, 0)) / size) if size > 0 else 0.0


def resample_mask(mask: DataFrame, src_affine, dst_dims, dst_affine) -> DataFrame:
    return binarise(resample_nearest(binarise(mask).withColumn("value", F.lit(1.0)), src_affine, dst_dims, dst_affine))


def project_atlas(atlas: DataFrame, src_affine, dst_dims, dst_affine) -> DataFrame:
    """Cleaned labels, resampled to nearest; background is left out."""
    labels = atlas.withColumn("value", clean_label(F.col("value")))
    return resample_nearest(labels, src_affine, dst_dims, dst_affine).where("value > 0")

"""Vector fields (volume_id, x, y, z, dx, dy, dz) in voxels: integration and warps over bricks with halos, sampling at any points by joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import bricks
from .elementwise import foreground, magnitude, min_max, robust_normalise
from .geometry import AT, _weigh, linear_id, resize_linear

D = ["dx", "dy", "dz"]


def sample_field(points: DataFrame, field: DataFrame, dims) -> DataFrame:
    """Field values at fractional points (AT, sx, sy, sz), clamped to the edge, as dx, dy, dz."""
    clamped = points.withColumns({f"s{c}": F.least(F.lit(float(n - 1)), F.greatest(F.lit(0.0), F.col(f"s{c}"))) for c, n in zip("xyz", dims, strict=True)})
    return _weigh(clamped.select(*AT, "sx", "sy", "sz"), field, AT, D)


def integrate_bricks(velocity: DataFrame, steps: int = 7, side: int = bricks.SIDE) -> DataFrame:
    """Displacement bricks of a stationary velocity field by scaling and squaring: halve ``steps`` times, then compose with itself as often."""
    d = bricks.scaled(velocity, 0.5**steps)
    for _ in range(steps):
        d = bricks.sample(d, d, 3, "add", clamp=True, side=side)
    return d


def inverse_bricks(field: DataFrame, rounds: int = 8, side: int = bricks.SIDE) -> DataFrame:
    """Bricks of the field e with p + e(p) taken back to p, by fixed-point steps e = -d(p + e)."""
    e = bricks.scaled(field, 0.0)
    for _ in range(rounds):
        e = bricks.sample(e, field, 3, "negative", clamp=True, side=side)
    return e


def integrate(velocity: DataFrame, dims, steps: int = 7, side: int = bricks.SIDE) -> DataFrame:
    """integrate_bricks of dense rows (AT, dx, dy, dz); ``dims`` are three numbers or a table of grids."""
    return bricks.from_bricks(integrate_bricks(bricks.to_bricks(velocity, dims, tuple(D), side), steps, side), tuple(D), side)


def enlarge(field: DataFrame, dims, new_dims) -> DataFrame:
    """End-aligned enlargement; displacements grow with the grid."""
    out = resize_linear(field, dims, new_dims, tuple(D))
    return out.withColumns({f"d{c}": F.col(f"d{c}") * (m / n) for c, n, m in zip("xyz", dims, new_dims, strict=True)})


def warp(volume: DataFrame, field: DataFrame, dims, nearest: bool = False, side: int = bricks.SIDE) -> DataFrame:
    """value(p) = volume(p + d(p)), trilinear or nearest; 0 where p + d(p) lies outside the grid. Voxels that the volume lacks are 0, the field is dense."""
    moved = bricks.sample(bricks.to_bricks(field, dims, tuple(D), side), bricks.to_bricks(volume, dims, side=side), 1, nearest=nearest, side=side)
    return bricks.from_bricks(moved, side=side)


def inverse_field(field: DataFrame, dims, rounds: int = 8, side: int = bricks.SIDE) -> DataFrame:
    """inverse_bricks of dense rows."""
    return bricks.from_bricks(inverse_bricks(bricks.to_bricks(field, dims, tuple(D), side), rounds, side), tuple(D), side)


def inverse_warp(volume: DataFrame, field: DataFrame, dims, nearest: bool = False, rounds: int = 8, side: int = bricks.SIDE) -> DataFrame:
    back = inverse_bricks(bricks.to_bricks(field, dims, tuple(D), side), rounds, side)
    moved = bricks.sample(back, bricks.to_bricks(volume, dims, side=side), 1, nearest=nearest, side=side)
    return bricks.from_bricks(moved, side=side)


def warp_mask(mask: DataFrame, field: DataFrame, dims) -> DataFrame:
    return warp(mask.withColumn("value", F.lit(1.0)), field, dims).where("value > 0.5")


def warp_labels(labels: DataFrame, field: DataFrame, dims, inverse: bool = False, rounds: int = 8, side: int = bricks.SIDE) -> DataFrame:
    """Labels taken through a field or, with ``inverse``, back through it: nearest values, background left out."""
    moved = inverse_warp(labels, field, dims, True, rounds, side) if inverse else warp(labels, field, dims, True, side)
    return moved.where("value > 0")


def inverse_warp_mask(mask: DataFrame, field: DataFrame, dims, rounds: int = 8, side: int = bricks.SIDE) -> DataFrame:
    return inverse_warp(mask.withColumn("value", F.lit(1.0)), field, dims, False, rounds, side).where("value > 0.5")


def register(velocity: DataFrame, moving: DataFrame, half_dims, dims, steps: int = 7, side: int = bricks.SIDE) -> tuple[DataFrame, DataFrame]:
    """Displacement (with its magnitude) of a velocity field on a smaller grid and the moving volume warped by it."""
    field = written(enlarge(integrate(velocity, half_dims, steps, side), half_dims, dims))
    return field.withColumn("magnitude", magnitude(*(F.col(c) for c in D))), warp(moving, field, dims, side=side)


def register_pairs(moving: DataFrame, fixed: DataFrame, dims, model: Callable, model_dims=None, field_dims=None, mask: DataFrame | None = None, steps: int = 7, side: int = bricks.SIDE) -> tuple[DataFrame, DataFrame]:
    """What ``register`` gives for pairs of dense volumes (AT, value) that share a volume_id, with the velocities of an injected model.

    With a mask of the moving volumes (volume_id, vid) both sides are scaled by their robust percentiles, the fixed one within its foreground, and 0
    outside; without one the moving volumes are scaled from 0 to 1. Both are resized to ``model_dims``. The model is called once a pair with two arrays of that size and
    gives three by ``field_dims``; a pair is one group, of the size that the model takes. A volume without its partner raises.
    """
    model_dims, field_dims = tuple(model_dims or dims), tuple(field_dims or dims)
    own = lambda df: df.select(*AT, linear_id(dims).alias("vid"), F.col("value").cast("double").alias("value"))
    moving, fixed = written(own(moving)), written(own(fixed))
    if mask is None:
        source, target = min_max(moving), fixed
    else:
        source = robust_normalise(moving, mask, True)
        target = robust_normalise(fixed, foreground(fixed).select("volume_id", "vid"), True)
    source = written(source.select(*AT, "value"))
    sides = [resize_linear(v, dims, model_dims) if tuple(dims) != model_dims else v for v in (source, target.select(*AT, "value"))]

    def call(rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros(model_dims)
        out[tuple(rows[c] for c in "xyz")] = rows["value"]
        return out

    def velocity(key, one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            raise ValueError(f"{key[0]} is not in both sets of volumes")
        d = np.asarray(model(call(one), call(other)), float)
        if d.shape != (3, *field_dims):
            raise ValueError(f"the model gave {d.shape}, not {(3, *field_dims)}")
        at = np.indices(field_dims).reshape(3, -1)
        return pd.DataFrame({"volume_id": key[0], **dict(zip("xyz", at, strict=True)), **dict(zip(D, d.reshape(3, -1), strict=True))})

    pairs = sides[0].groupBy("volume_id").cogroup(sides[1].groupBy("volume_id"))
    found = pairs.applyInPandas(velocity, "volume_id string, x int, y int, z int, dx double, dy double, dz double")
    return register(found, source, field_dims, dims, steps, side)

"""Grids, spaces and affine maps: the small values that plans are built from on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0))


@dataclass(frozen=True)
class VolumeMeta:
    """Grid of a volume: dims, voxel-to-world affine, the space it is in and where it came from."""

    volume_id: str
    dims: tuple[int, int, int]
    affine: tuple[tuple[float, ...], ...] = IDENTITY
    space: str | None = None
    role: str | None = None
    source_stage: str | None = None

    def __post_init__(self):
        if len(self.dims) != 3 or min(self.dims) < 1:
            raise ValueError("dims must be three positive numbers")

    @property
    def size(self) -> int:
        return self.dims[0] * self.dims[1] * self.dims[2]


def check_length(meta: VolumeMeta, length: int) -> None:
    if length != meta.size:
        raise ValueError(f"{meta.volume_id}: {length} values for a grid of {meta.size}")


def same_grid(a: VolumeMeta, b: VolumeMeta, tolerance: float = 1e-3) -> bool:
    """Equal dims and affines equal within the tolerance; a missing affine counts as equal."""
    if a.dims != b.dims:
        return False
    return a.affine is None or b.affine is None or bool(np.allclose(a.affine, b.affine, atol=tolerance, rtol=0))


def require_space(meta: VolumeMeta, space: str, require_metadata: bool = False) -> None:
    """Raises unless the volume is in the space; untagged volumes pass unless metadata is required."""
    if meta.space is None:
        if require_metadata:
            raise ValueError(f"{meta.volume_id} has no space")
    elif meta.space != space:
        raise ValueError(f"{meta.volume_id} is in {meta.space}, not in {space}")


def require_same_space(a: VolumeMeta, b: VolumeMeta, require_metadata: bool = False) -> None:
    for meta, other in ((a, b), (b, a)):
        if other.space is not None:
            require_space(meta, other.space, require_metadata)


def inverse(affine) -> np.ndarray:
    m = np.asarray(affine, float)
    if abs(np.linalg.det(m[:3, :3])) < 1e-12:
        raise ValueError("the affine can't be inverted")
    return np.linalg.inv(m)


def map_point(m, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The affine image of a point, as three linear expressions."""
    return tuple(F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3])) for r in np.asarray(m, float)[:3])


def orientation(affine) -> tuple[tuple[int, int, int], tuple[bool, bool, bool]]:
    """For each world axis the grid axis that follows it most, taken greedily, and whether it runs backwards."""
    m = np.asarray(affine, float)[:3, :3]
    free, perm = [0, 1, 2], []
    for axis in range(3):
        best = max(free, key=lambda k: (abs(m[axis, k]), -k))
        free.remove(best)
        perm.append(best)
    return tuple(perm), tuple(bool(m[axis, k] < 0) for axis, k in enumerate(perm))


def conform_dims(dims, low: int = 192, high: int = 320, step: int = 64) -> tuple[int, int, int]:
    return tuple(min(high, max(low, -(-d // step) * step)) for d in dims)


def padded_dims(dims, patch) -> tuple[int, int, int]:
    """Dims padded to patch size: up to it if smaller, up to its next multiple if larger."""
    return tuple(p if d < p else d if d % p == 0 else -(-d // p) * p for d, p in zip(dims, patch, strict=True))


def target_spacing(dims, spacing, box) -> float:
    """The spacing at which the crop (box: its sizes in voxels, None if it is empty) fits into 191 voxels, if the smallest extent keeps 48 of them.

    It is at most 2 mm and at least 1 mm, or the finest spacing where that lies between them; 1 mm for an empty crop.
    """
    if box is None:
        return 1.0
    keeps = min(n * s for n, s in zip(dims, spacing, strict=True)) / 48
    fits = max(n * s for n, s in zip(box, spacing, strict=True)) / 191
    return max(min(2.0, max(1.0, min(spacing))), min(2.0, keeps, fits))


def top_percent_quantile(percent: float) -> float:
    return 1 - min(10.0, max(0.0, percent)) / 100


def principal_axes(covariance) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order and their unit axes as columns."""
    values, axes = np.linalg.eigh(np.asarray(covariance, float))
    return values[::-1], axes[:, ::-1]


def centroid_prealign(fixed, moving, flips=(-1.0, 1.0, 1.0)) -> np.ndarray:
    """Affine that takes the fixed centroid to the moving one with axes flipped."""
    out = np.diag([*flips, 1.0])
    out[:3, 3] = np.asarray(moving, float) - out[:3, :3] @ np.asarray(fixed, float)
    return out


def axes_prealign(fixed_mean, fixed_cov, moving_mean, moving_cov, prior=None) -> np.ndarray:
    """Rigid map from fixed to moving by principal axes: best permutation and signs against a prior, determinant +1."""
    from itertools import permutations

    prior = np.eye(3) if prior is None else np.asarray(prior, float)[:3, :3]
    _, f = principal_axes(fixed_cov)
    _, m = principal_axes(moving_cov)
    likeness = m.T @ prior @ f
    order = max(permutations(range(3)), key=lambda p: sum(abs(likeness[k, j]) for j, k in enumerate(p)))
    m = m[:, list(order)]
    along = np.array([(m[:, j] @ prior @ f[:, j]) for j in range(3)])
    m = m * np.where(along < 0, -1.0, 1.0)
    rotation = m @ f.T
    if np.linalg.det(rotation) < 0:
        m[:, int(np.argmin(np.abs(along)))] *= -1
        rotation = m @ f.T
    out = np.eye(4)
    out[:3, :3] = rotation
    out[:3, 3] = np.asarray(moving_mean, float) - rotation @ np.asarray(fixed_mean, float)
    return out

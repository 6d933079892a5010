"""Volumes of different grids against NumPy, one by one: any affines, empty volumes, ties of axes, affines without inverse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill import model
from voxelmill.operators import geometry, grids

META = "volume_id string, nx int, ny int, nz int, affine array<array<double>>"


def some_grids(seed, n=4):
    rng, out = np.random.default_rng(seed), {}
    for k in range(n):
        affine = np.eye(4)
        affine[:3, :3] = np.linalg.qr(rng.normal(0, 1, (3, 3)))[0] * rng.uniform(0.6, 2.5, 3)
        affine[:3, 3] = rng.uniform(-3, 3, 3)
        out[f"v{k}"] = (tuple(int(v) for v in rng.integers(3, 8, 3)), affine)
    return out


def meta(spark, found):
    return spark.createDataFrame([(k, *d, m.tolist()) for k, (d, m) in found.items()], META)


def rows(spark, data):
    listed = [(k, *map(int, p), float(v[p])) for k, v in data.items() for p in np.ndindex(v.shape)]
    return spark.createDataFrame(listed, "volume_id string, x int, y int, z int, value double")


def taken(data, place, linear):
    """data at fractional places (points, 3); corners outside count as 0."""
    out = np.zeros(len(place))
    for i, p in enumerate(place):
        if not linear:
            q = tuple(np.floor(p + 0.5).astype(int))
            out[i] = data[q] if all(0 <= a < n for a, n in zip(q, data.shape, strict=True)) else 0
            continue
        low = np.floor(p).astype(int)
        for d in np.ndindex(2, 2, 2):
            q = tuple(low + d)
            if all(0 <= a < n for a, n in zip(q, data.shape, strict=True)):
                out[i] += data[q] * np.prod([1 - abs(a - b) for a, b in zip(p, q, strict=True)])
    return out


@pytest.fixture(scope="module")
def both(spark):
    source, target = some_grids(1), some_grids(2)
    rng = np.random.default_rng(3)
    data = {k: np.where(rng.random(d) < 0.4, rng.integers(1, 9, d), 0).astype(float) for k, (d, _) in source.items()}
    return source, target, data


@pytest.mark.parametrize("linear", [False, True])
def test_resampling(spark, both, linear):
    source, target, data = both
    f = grids.resample_linear if linear else grids.resample_nearest
    got = {(r.volume_id, r.x, r.y, r.z): r.value for r in f(rows(spark, data), meta(spark, source), meta(spark, target)).collect()}
    want = {}
    for k, (dims, m) in target.items():
        at = np.array(list(np.ndindex(dims)))
        place = (np.linalg.inv(source[k][1]) @ m @ np.c_[at, np.ones(len(at))].T).T[:, :3]
        want |= {(k, *map(int, p)): v for p, v in zip(at, taken(data[k], place, linear), strict=True)}
    assert got == pytest.approx(want)


def test_sparse_masks_are_the_resampled_ones(spark, both):
    source, target, data = both
    s, t, mask = meta(spark, source), meta(spark, target), rows(spark, data).where("value > 0")
    got = sorted(map(tuple, grids.resample_mask(mask, s, t).collect()))
    want = sorted((r.volume_id, r.x, r.y, r.z) for r in grids.resample_nearest(mask, s, t).where("value > 0").collect())
    assert got == want and got
    finer = {k: (tuple(3 * n for n in d), m @ np.diag([0.31, 0.31, 0.31, 1])) for k, (d, m) in source.items()}
    got = grids.resample_mask(mask, s, meta(spark, finer)).count()
    assert got == grids.resample_nearest(mask, s, meta(spark, finer)).where("value > 0").count()


def test_orientation_and_back(spark, both):
    source, _, data = both
    source = source | {"tie": ((3, 4, 5), np.array([[1.0, 1, 0, 0], [1, -1, 0, 0], [0, 0, -2, 0], [0, 0, 0, 1]]))}
    data = data | {"tie": np.arange(60.0).reshape(3, 4, 5)}
    m, v = meta(spark, source), rows(spark, data)
    how = {r.volume_id: r.o for r in m.select("volume_id", grids.orientation(F.col("affine")).alias("o")).collect()}
    turned = grids.orient(v, m)
    new = {r.volume_id: r for r in grids.oriented_meta(m).collect()}
    got = {}
    for r in turned.collect():
        got[r.volume_id, r.x, r.y, r.z] = r.value
    for k, (dims, affine) in source.items():
        perm, flip = model.orientation(affine)
        assert (tuple(how[k].perm), tuple(how[k].flip)) == (perm, flip)
        assert (new[k].nx, new[k].ny, new[k].nz) == tuple(dims[p] for p in perm)
        for old in np.ndindex(dims):
            p = [dims[a] - 1 - old[a] if f else old[a] for a, f in zip(perm, flip, strict=True)]
            assert got[(k, *p)] == data[k][old]
            assert np.array(new[k].affine) @ [*p, 1] == pytest.approx(affine @ [*old, 1])
    assert sorted(map(tuple, grids.orient_back(turned, m).collect())) == sorted(map(tuple, v.collect()))


def test_boxes_spacing_and_views(spark, both):
    source, target, data = both
    source = source | {"dark": ((4, 4, 4), np.eye(4))}
    m, v = meta(spark, source), rows(spark, data).where("x > 0")
    found = {r.volume_id: r for r in grids.boxes(v, m, 1).collect()}
    spacing = {r.volume_id: r.spacing for r in grids.target_spacing(grids.boxes(v, m), m).collect()}
    assert found["dark"].empty and found["dark"].x0 is None and spacing["dark"] == 1.0
    for k, d in data.items():
        at = np.argwhere(d * (np.indices(d.shape)[0] > 0))
        lo, hi = np.maximum(at.min(0) - 1, 0), np.minimum(at.max(0) + 2, d.shape)
        assert (found[k].x0, found[k].y0, found[k].z0, found[k].x1, found[k].y1, found[k].z1) == (*lo, *hi)
        size = np.linalg.norm(source[k][1][:3, :3], axis=0)
        assert spacing[k] == pytest.approx(model.target_spacing(source[k][0], size, at.max(0) + 1 - at.min(0)))
    views = {r.volume_id: r for r in grids.view_overlap(m, meta(spark, target), ["volume_id"]).collect()}
    for k, (dims, affine) in target.items():
        assert views[k].overlap == pytest.approx(geometry.view_overlap(*source[k], dims, affine))
        assert views[k].warning and not views[k].same_grid
    same = grids.view_overlap(m, m, ["volume_id"]).collect()
    assert len(same) == 5 and all(r.same_grid and r.close and r.warning is None and r.overlap == pytest.approx(1) for r in same)


def test_crop_centre_and_back(spark, both):
    source, _, data = both
    m, v = meta(spark, source), rows(spark, data).where("value > 0")
    box = grids.boxes(v, m)
    back = grids.place_back(grids.crop(v, box), box, m)
    assert back.count() == sum(int(np.prod(d)) for d, _ in source.values())
    assert sorted(map(tuple, back.where("value > 0").collect())) == sorted(map(tuple, v.collect()))
    wide = grids.to_grid(m, (11, 12, 13), np.eye(4))
    assert sorted(map(tuple, grids.centre(grids.centre(v, m, wide), wide, m).collect())) == sorted(map(tuple, v.collect()))
    narrow = grids.to_grid(m, (2, 2, 2), np.eye(4))
    assert grids.centre(v, m, narrow).where("greatest(x, y, z) > 1 or least(x, y, z) < 0").count() == 0


def test_an_affine_without_inverse_raises(spark, both):
    source, _, data = both
    flat = {k: (d, np.diag([1.0, 1, 0, 1])) for k, (d, _) in source.items()}
    with pytest.raises(Exception, match="can't be inverted"):
        grids.resample_nearest(rows(spark, data), meta(spark, flat), meta(spark, source)).collect()
    assert grids.resample_nearest(rows(spark, data).limit(0), meta(spark, source).limit(0), meta(spark, source)).count() == 0

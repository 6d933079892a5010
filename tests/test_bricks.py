"""Bricks with halos against NumPy: sampling with any halo, both passes, dilation over many bricks, and what a step shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import bricks, morphology, registration

D = ("dx", "dy", "dz")


def rows(spark, data, names, volume_id="v"):
    at = np.indices(data.shape[1:]).reshape(3, -1).T
    schema = "volume_id string, x int, y int, z int, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame([(volume_id, *map(int, p), *map(float, v)) for p, v in zip(at, data.reshape(len(names), -1).T, strict=True)], schema)


def array(df, names, dims):
    out = np.zeros((len(names), *dims))
    for r in df.collect():
        out[:, r.x, r.y, r.z] = [r[n] for n in names]
    return out


def taken(source, place, clamp, nearest):
    """source at fractional places (3, points), point by point."""
    dims, out = source.shape[1:], np.zeros((len(source), place.shape[1]))
    for i, p in enumerate(place.T):
        if clamp:
            p = np.clip(p, 0, np.array(dims) - 1)
        if (p < 0).any() or (p > np.array(dims) - 1).any():
            continue
        if nearest:
            out[:, i] = source[(slice(None), *np.floor(p + 0.5).astype(int))]
            continue
        low = np.floor(p).astype(int)
        for d in np.ndindex(2, 2, 2):
            w = np.prod([q - a if s else 1 - (q - a) for q, a, s in zip(p, low, d, strict=True)])
            if w > 0:
                out[:, i] += w * source[(slice(None), *(low + d))]
    return out


@pytest.mark.parametrize(("halo", "clamp", "nearest", "combine"), [(None, False, False, "value"), (1, False, False, "value"), (2, True, False, "add"), (1, True, False, "negative"), (1, False, True, "value")])
def test_sampling(spark, halo, clamp, nearest, combine):
    dims, side, rng = (7, 5, 9), 4, np.random.default_rng(3)
    disp, source = rng.normal(0, 2.5, (3, *dims)), rng.normal(0, 1, (3, *dims))
    want = taken(source, np.indices(dims).reshape(3, -1) + disp.reshape(3, -1), clamp, nearest).reshape(3, *dims)
    want = {"value": want, "add": disp + want, "negative": -want}[combine]
    field, known = (bricks.to_bricks(rows(spark, a, D), dims, D, side) for a in (disp, source))
    got = bricks.sample(field, known, 3, combine, clamp, nearest, halo, side)
    assert np.allclose(array(bricks.from_bricks(got, D, side), D, dims), want, atol=1e-12)
    assert got.agg(F.max("reach")).first()[0] == pytest.approx(np.abs(want).max())


def test_volumes_of_different_grids(spark):
    rng, side = np.random.default_rng(4), 3
    grids = {"a": (4, 7, 3), "b": (8, 3, 5)}
    data = {k: rng.normal(0, 1, (3, *d)) for k, d in grids.items()}
    meta = spark.createDataFrame([(k, *d) for k, d in grids.items()], "volume_id string, nx int, ny int, nz int")
    field = rows(spark, data["a"], D, "a").unionByName(rows(spark, data["b"], D, "b"))
    out = registration.integrate(field, meta, 2, side)
    for k, dims in grids.items():
        want = data[k] / 4
        for _ in range(2):
            want = want + taken(want, np.indices(dims).reshape(3, -1) + want.reshape(3, -1), True, False).reshape(3, *dims)
        assert np.allclose(array(out.where(F.col("volume_id") == k), D, dims), want)


@pytest.mark.parametrize(("radius", "side"), [(1, 4), (3, 4), (5, 4), (2, 32)])
def test_dilation_over_bricks(spark, radius, side):
    dims, rng = (9, 10, 11), np.random.default_rng(radius)
    at = {tuple(map(int, p)) for p in rng.integers(0, dims, (4, 3))} | {(0, 0, 0)}
    mask = spark.createDataFrame([("v", *p) for p in at], "volume_id string, x int, y int, z int")
    want = {p for p in np.ndindex(dims) if any(sum(abs(a - b) for a, b in zip(p, q, strict=True)) <= radius for q in at)}
    assert {(r.x, r.y, r.z) for r in morphology.dilate(mask, dims, radius, side).collect()} == want
    assert morphology.dilate(mask.limit(0), dims, radius, side).count() == 0


def test_a_step_shuffles_borders_only(spark):
    dims, side = (9, 9, 9), 3
    v = bricks.to_bricks(rows(spark, np.ones((1, *dims)), ["value"]), dims, side=side)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = v.join(bricks.borders(v, 1, side), bricks.KEY, "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2
    slab = bricks.borders(v, 1, side).select(F.explode("slabs").alias("s")).agg(F.max(F.length("s.data"))).first()[0]
    assert slab == 8 * side * side


def test_a_halo_wider_than_a_brick_raises(spark):
    v = bricks.to_bricks(rows(spark, np.ones((1, 3, 3, 3)), ["value"]), (3, 3, 3), side=2)
    with pytest.raises(ValueError, match="wider than a brick"):
        bricks.around(v, 3, lambda b: b, side=2)


def resized(data, dims):
    """Corner-aligned trilinear resize of (channels, x, y, z)."""
    scale = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(data.shape[1:], dims, strict=True)]
    place = np.indices(dims, float).reshape(3, -1) * np.array(scale)[:, None]
    return taken(data, place, True, False).reshape(-1, *dims)


@pytest.mark.parametrize("masked", [False, True])
def test_registered_pairs(spark, masked):
    dims, small, half, rng = (6, 8, 7), (4, 5, 4), (3, 4, 4), np.random.default_rng(8)
    data = {k: (rng.random((1, *dims)) * 9, rng.random((1, *dims)) * 4) for k in ("a", "b")}

    def model(moving, fixed):
        assert moving.shape == fixed.shape == small
        return np.stack([moving[:3, :4] - fixed[:3, :4], 2 * moving[1:, 1:], fixed[:3, 1:] - 1])

    sides = [rows(spark, data["a"][i], ["value"], "a").unionByName(rows(spark, data["b"][i], ["value"], "b")) for i in (0, 1)]
    inside = np.arange(np.prod(dims)) % 4 != 1
    mask = spark.createDataFrame([(k, int(v)) for k in data for v in np.flatnonzero(inside)], "volume_id string, vid int") if masked else None
    field, warped = registration.register_pairs(*sides, dims, model, small, half, mask, 2, 4)

    def robust(v, keep):
        flat = v.ravel(order="F")
        some = np.sort(flat[keep])
        lo, hi = some[int((len(some) - 1) * 0.01)], some[int((len(some) - 1) * 0.99)]
        return np.where(keep, np.clip((flat - lo) / (hi - lo), 0, 1), 0).reshape(v.shape, order="F")

    for k, (moving, fixed) in data.items():
        m, f = moving[0], fixed[0]
        source = robust(m, inside) if masked else (m - m.min()) / (m.max() - m.min())
        target = robust(f, f.ravel(order="F") > 0.05 * f.max()) if masked else f
        v = model(*(resized(s[None], small)[0] for s in (source, target))) / 4
        for _ in range(2):
            v = v + taken(v, np.indices(half).reshape(3, -1) + v.reshape(3, -1), True, False).reshape(3, *half)
        d = resized(v, dims) * np.array([m / n for n, m in zip(half, dims, strict=True)])[:, None, None, None]
        want = taken(source[None], np.indices(dims).reshape(3, -1) + d.reshape(3, -1), False, False).reshape(1, *dims)
        own = lambda df: df.where(F.col("volume_id") == k)  # noqa: B023, E731
        assert np.allclose(array(own(field), D, dims), d) and np.allclose(array(own(warped), ["value"], dims), want)
        assert np.allclose(array(own(field), ["magnitude"], dims)[0], np.sqrt((d**2).sum(0)))
    with pytest.raises(Exception, match="not in both"):
        registration.register_pairs(sides[0], sides[1].where("volume_id = 'a'"), dims, model, small, half)


def test_labels_through_a_field_and_back(spark):
    dims = (6, 6, 6)
    labels = spark.createDataFrame([("v", 1, 2, 3, 7.0), ("v", 4, 4, 4, 9.0)], "volume_id string, x int, y int, z int, value double")
    shift = np.zeros((3, *dims))
    shift[0] = 1
    field = rows(spark, shift, D)
    at = lambda df: {(r.x, r.y, r.z, r.value) for r in df.collect()}
    assert at(registration.warp_labels(labels, field, dims, side=3)) == {(0, 2, 3, 7.0), (3, 4, 4, 9.0)}
    assert at(registration.warp_labels(labels, field, dims, True, side=3)) == {(2, 2, 3, 7.0), (5, 4, 4, 9.0)}
    assert {(r.x, r.y, r.z) for r in registration.inverse_warp_mask(labels.drop("value"), field, dims, side=3).collect()} == {(2, 2, 3), (5, 4, 4)}

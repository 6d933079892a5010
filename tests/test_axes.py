"""Principal axes and rigid maps of many masks at once against NumPy, one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill import model
from voxelmill.operators import axes, connectome


def clouds(seed, n=6):
    rng = np.random.default_rng(seed)
    return {f"v{k}": np.unique((rng.normal(0, (6, 3, 1.5), (80, 3)) @ np.linalg.qr(rng.normal(0, 1, (3, 3)))[0]).round().astype(int), axis=0) for k in range(n)}


def table(spark, found):
    return spark.createDataFrame([(k, *map(int, p)) for k, at in found.items() for p in at], "volume_id string, x int, y int, z int")


def test_axes_of_all_volumes(spark):
    found = clouds(1) | {"line": np.array([(k, 0, 0) for k in range(5)]), "cube": np.array(list(np.ndindex(3, 3, 3))), "one": np.array([(4, 5, 6)])}
    rows = {r.volume_id: r for r in axes.principal_axes(table(spark, found)).collect()}
    assert set(rows) == set(found)
    for k, at in found.items():
        values, vectors = np.array([e.value for e in rows[k].axes]), np.array([e.axis for e in rows[k].axes]).T
        cov = np.cov(at.T, bias=True) if len(at) > 1 else np.zeros((3, 3))
        assert values == pytest.approx(np.linalg.eigvalsh(cov)[::-1], abs=1e-9)
        assert np.allclose(cov @ vectors, vectors * values, atol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-12)
        assert rows[k].mean == pytest.approx(list(at.mean(0)))


def test_rigid_maps_of_all_pairs(spark):
    fixed, moving = clouds(2), clouds(3)
    got = {r.volume_id: np.array(r.affine) for r in axes.prealign(axes.principal_axes(table(spark, fixed)), axes.principal_axes(table(spark, moving)), ["volume_id"]).collect()}
    for k in fixed:
        want = model.axes_prealign(fixed[k].mean(0), np.cov(fixed[k].T, bias=True), moving[k].mean(0), np.cov(moving[k].T, bias=True))
        assert np.allclose(got[k], want[:3], atol=1e-9)
        assert np.linalg.det(got[k][:, :3]) == pytest.approx(1)


def test_states_add_up(spark, tmp_path):
    rng, by = np.random.default_rng(5), ["source", "target"]
    rows = [(s, a, b, float(rng.normal(0.4, 0.3))) for s in range(9) for a in "abc" for b in "abc" if a != b and not (s > 6 and b == "c")] + [(0, "x", "y", 1.5), (1, "x", "y", None)]
    z = spark.createDataFrame(rows, "subject int, source string, target string, z double")
    for run, some in (("a", "subject < 2"), ("b", "subject between 2 and 7"), ("c", "subject > 7"), ("b", "subject between 2 and 7")):
        connectome.add_run(connectome.pair_state(z.where(some), by), str(tmp_path), run)
    for sample in (True, False):
        want = {(r.source, r.target): r for r in connectome.group_t(z, by, sample).collect()}
        got = {(r.source, r.target): r for r in connectome.state_t(connectome.stored_state(spark, str(tmp_path), by), by, sample).collect()}
        assert set(got) == set(want)
        for k, r in got.items():
            assert (r.n, r.mean_z, r.t) == pytest.approx((want[k].n, want[k].mean_z, want[k].t))
    assert spark.read.parquet(str(tmp_path)).select(F.count_distinct("run")).first()[0] == 3

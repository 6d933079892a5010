"""The component tree and the sweep with clean-up against a flood fill at each threshold."""

import itertools

import numpy as np
import pytest

from voxelmill.operators import tree

AROUND = [d for d in itertools.product((-1, 0, 1), repeat=3) if d != (0, 0, 0)]


def flood(at):
    left, out = set(at), []
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            p = todo.pop()
            for d in AROUND:
                q = tuple(a + b for a, b in zip(p, d, strict=True))
                if q in left:
                    left.remove(q)
                    found.add(q)
                    todo.append(q)
        out.append(found)
    return out


@pytest.mark.parametrize(("block", "least"), [(3, 3), (4, 1), (32, 5)])
def test_sweep_without_small_components(spark, block, least):
    dims, rng = (9, 8, 10), np.random.default_rng(block)
    thresholds = [0.3, 0.6, 0.75, 0.9, 0.99]
    volumes = {"a": rng.random(dims) ** 2, "b": np.round(rng.random(dims), 1), "c": np.zeros(dims)}
    truth = {"a": {p for p in np.ndindex(dims) if rng.random() < 0.2}, "b": set(), "d": {(0, 0, 0)}}
    schema = "volume_id string, x int, y int, z int"
    p = spark.createDataFrame([(k, *at, float(v[at])) for k, v in volumes.items() for at in np.ndindex(dims)], schema + ", p double")
    t = spark.createDataFrame([(k, *at) for k, v in truth.items() for at in v] * 2, schema)
    got = {(r.volume_id, r.threshold): (r.tp, r.fp, r.fn) for r in tree.threshold_sweep(p, t, dims, thresholds, least, block).collect()}
    want = {}
    for k in "abcd":
        true = truth.get(k, set())
        for level in thresholds:
            at = {q for q in np.ndindex(dims) if k in volumes and volumes[k][q] >= level}
            kept = set().union(*(c for c in flood(at) if len(c) >= least))
            want[k, level] = (len(kept & true), len(kept - true), len(true - kept))
    assert got == want
    assert tree.threshold_sweep(p.limit(0), t.limit(0), dims, thresholds, least, block).count() == 0


def test_nested_labels_go_on_from_higher_levels():
    rng = np.random.default_rng(7)
    at = np.array([p for p in np.ndindex(6, 6, 6) if rng.random() < 0.6])
    ids, level = at[:, 0] + 6 * (at[:, 1] + 6 * at[:, 2]), rng.integers(1, 5, len(at))
    for k, found in enumerate(tree.nested_labels(*at.T, ids, level), 1):
        comps = flood({tuple(p) for p in at[level >= k].tolist()})
        want = {p: min(a + 6 * (b + 6 * c) for a, b, c in comp) for comp in comps for p in comp}
        assert {tuple(p): f for p, f in zip(at.tolist(), found.tolist(), strict=True) if f >= 0} == want


def test_thresholds_are_needed(spark):
    empty = spark.createDataFrame([], "volume_id string, x int, y int, z int, p double")
    with pytest.raises(ValueError, match="at least one"):
        tree.threshold_sweep(empty, empty, (2, 2, 2), [])

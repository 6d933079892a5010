"""Sliding windows over bricks against NumPy, patch by patch, for bricks smaller and larger than patches."""

import itertools

import numpy as np
import pytest

from voxelmill.operators import score
from voxelmill.operators.geometry import patch_starts


def make_scorer():
    def scorer(block):
        """Something that a flip, a patch's edge and the channel's order change."""
        block = block if block.ndim == 4 else block[None]
        out = 0.5 * block[0] + 0.1 * block[-1] ** 2
        out[:-1] += 0.3 * block[0, 1:]
        out[:, :, 1:] -= 0.2 * block[-1, :, :, :-1]
        return out

    return scorer


@pytest.mark.parametrize(("side", "patch", "overlap", "channels", "flips"), [(3, (4, 5, 4), 0.25, 0, 1), (5, (4, 3, 6), 0.5, 0, 8), (32, (4, 4, 4), 0.6, 2, 1), (4, (9, 9, 12), 0.25, 3, 2)])
def test_blending(spark, side, patch, overlap, channels, flips):
    dims, sigma, rng, scorer = (7, 8, 9), 2.0, np.random.default_rng(side), make_scorer()
    names = {"a": rng.normal(0, 1, (max(1, channels), *dims)), "b": rng.normal(0, 1, (max(1, channels), *dims))}
    rows = [(k, c, *p, float(v[(c, *p)])) for k, v in names.items() for c in range(len(v)) for p in np.ndindex(dims)]
    df = spark.createDataFrame(rows, "volume_id string, channel int, x int, y int, z int, value double")
    df = df if channels else df.drop("channel")
    padded = tuple(max(n, p) for n, p in zip(dims, patch, strict=True))
    got = {(r.volume_id, r.x, r.y, r.z): (r.p, r.w) for r in score.blended(df, padded, patch, scorer, overlap, sigma, score.FLIPS[:flips], channels, side).collect()}
    weight = np.exp(-sum((i - (p - 1) / 2) ** 2 for i, p in zip(np.indices(patch), patch, strict=True)) / (2 * sigma**2))
    assert len(got) == 2 * np.prod(dims)
    for k, v in names.items():
        whole = np.zeros((len(v), *padded))
        whole[(slice(None), *(slice(n) for n in dims))] = v
        p, w = np.zeros(padded), np.zeros(padded)
        for start in itertools.product(*(patch_starts(n, q, overlap) for n, q in zip(padded, patch, strict=True))):
            at = tuple(slice(s, s + q) for s, q in zip(start, patch, strict=True))
            block = whole[(slice(None), *at)]
            block = block if channels else block[0]
            lead = int(bool(channels))
            mean = np.mean([np.flip(scorer(np.flip(block, tuple(a + lead for a in f))), f) for f in score.FLIPS[:flips]], axis=0)
            p[at] += mean * weight
            w[at] += weight
        for q in np.ndindex(dims):
            assert got[(k, *q)] == pytest.approx((p[q], w[q]))

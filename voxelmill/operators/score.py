"""Sliding-window scoring with an injected scorer: normalise, cut patches, score, blend, threshold, clean up.

The scorer is a function from a patch (a NumPy array of patch size) to probabilities of the same size. Each
call sees one patch, so memory is bounded by its size.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import bricks
from .elementwise import z_score
from .geometry import AT, patch_starts
from .morphology import remove_small

# The eight flips of test-time augmentation.
FLIPS = [(), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]


def gaussian_weight(patch, sigma: float) -> Column:
    """exp(-d^2 / (2 sigma^2)) by distance from the patch's centre."""
    d2 = sum((F.col(f"i{c}") - (p - 1) / 2) * (F.col(f"i{c}") - (p - 1) / 2) for c, p in zip("xyz", patch, strict=True))
    return F.exp(-d2 / (2 * sigma * sigma))


def score_patches(voxels: DataFrame, patch, scorer: Callable[[np.ndarray], np.ndarray], flips=FLIPS[:1]) -> DataFrame:
    """Mean probability over the flips, per voxel of each patch.

    Voxels with a column ``channel`` (0, 1, ...) are scored together: the scorer gets an array of channels by patch.
    """
    shape, schema = tuple(patch), "volume_id string, px int, py int, pz int, ix int, iy int, iz int, x int, y int, z int, p double"
    keep = ["volume_id", "px", "py", "pz", "ix", "iy", "iz", "x", "y", "z"]
    several = "channel" in voxels.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = tuple(rows[f"i{c}"].to_numpy() for c in "xyz")
        if several:
            block = np.zeros((int(rows["channel"].max()) + 1, *shape))
            block[(rows["channel"].to_numpy(), *at)] = rows["value"]
        else:
            block = np.zeros(shape)
            block[at] = rows["value"]
        p = np.mean([np.flip(scorer(np.flip(block, tuple(a + several for a in f))), f) for f in flips], axis=0)
        out = rows[keep].assign(p=p[at])
        return out.drop_duplicates(keep) if several else out

    kinds = [F.col("volume_id").cast("string"), *(F.col(c).cast("int") for c in keep[1:]), F.col("value").cast("double")]
    kinds += [F.col("channel").cast("int")] if several else []
    return voxels.select(*kinds).groupBy("volume_id", "px", "py", "pz").applyInPandas(run, schema)


def blend(scored: DataFrame, patch, sigma: float = 8.0) -> DataFrame:
    """volume_id, x, y, z, p, w: weighted sums over the patches that hold a voxel."""
    w = gaussian_weight(patch, sigma)
    return scored.groupBy(*AT).agg(F.sum(F.col("p") * w).alias("p"), F.sum(w).alias("w"))


def patch_stats(scored: DataFrame, first: int = 5) -> DataFrame:
    """Minimum, maximum and mean of the first patches in raster order."""
    per = scored.groupBy("volume_id", "pz", "py", "px").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.avg("p").alias("mean"))
    return per.orderBy("volume_id", "pz", "py", "px").limit(first)


_CUT = "array<struct<px: int, py: int, pz: int, at: array<int>, shape: array<int>, data: binary>>"
_ARROW_CUT = pa.list_(pa.struct([*((f"p{c}", pa.int32()) for c in "xyz"), ("at", pa.list_(pa.int32())), ("shape", pa.list_(pa.int32())), ("data", pa.binary())]))


def _shared(low: int, high: int, n: int, size: int, starts) -> list[tuple[int, int, int]]:
    """(start, first, end) of the runs that patches of one axis share with the voxels [low, high)."""
    return [(s, max(low, s), min(high, s + size)) for s in starts if s < high and low < min(s + size, n)]


def _weights(patch, sigma: float) -> np.ndarray:
    d2 = sum((i - (p - 1) / 2) ** 2 for i, p in zip(np.indices(tuple(patch)), patch, strict=True))
    return np.exp(-d2 / (2 * sigma * sigma))


def score_bricks(volume: DataFrame, patch, scorer: Callable[[np.ndarray], np.ndarray], overlap: float = 0.25, sigma: float = 8.0, flips=FLIPS[:1], channels: int = 0, side: int = bricks.SIDE) -> DataFrame:
    """Bricks of two channels, the blended sum of probability times weight and the sum of weights, of bricks of volumes.

    A brick sends each patch that it touches the block they share; a patch is put together, scored once for each flip, and sends the blocks back weighed. Both
    shuffles move blocks of bytes and no row is made for a voxel. Beyond the volume a patch holds zeros. With ``channels`` the scorer gets channels by patch.
    """
    patch, many = tuple(patch), max(1, channels)
    weight = _weights(patch, sigma)

    def cut(bx, by, bz, nx, ny, nz, data):
        out = []
        for *at, a, b, c, raw in bricks._rows(bx, by, bz, nx, ny, nz, data):
            dims = (a, b, c)
            sizes = bricks._sizes(at, dims, side)
            block = np.frombuffer(raw).reshape(many, *sizes)
            axes = [_shared(p * side, p * side + s, n, q, patch_starts(n, q, overlap)) for p, s, n, q in zip(at, sizes, dims, patch, strict=True)]
            pieces = []
            for runs in product(*axes):
                part = block[(slice(None), *(slice(f - p * side, e - p * side) for (_, f, e), p in zip(runs, at, strict=True)))]
                pieces.append({"px": runs[0][0], "py": runs[1][0], "pz": runs[2][0], "at": [f - s for s, f, _ in runs], "shape": list(part.shape[1:]), "data": np.ascontiguousarray(part).tobytes()})
            out.append(pieces)
        return pa.array(out, _ARROW_CUT)

    def rate(px, py, pz, nx, ny, nz, pieces):
        out = []
        for *start, a, b, c, parts in bricks._rows(px, py, pz, nx, ny, nz, pieces):
            dims, block = (a, b, c), np.zeros((many, *patch))
            for part in parts:
                where = tuple(slice(f, f + n) for f, n in zip(part["at"], part["shape"], strict=True))
                block[(slice(None), *where)] = np.frombuffer(part["data"]).reshape(many, *part["shape"])
            block = block if channels else block[0]
            lead = int(bool(channels))
            p = np.mean([np.flip(scorer(np.flip(block, tuple(k + lead for k in f))), f) for f in flips], axis=0)
            both = np.stack([p * weight, weight])
            sent = []
            first = [s // side for s in start]
            last = [(min(s + q, n) - 1) // side for s, q, n in zip(start, patch, dims, strict=True)]
            for brick in product(*(range(f, e + 1) for f, e in zip(first, last, strict=True))):
                runs = [(max(k * side, s), min((k + 1) * side, s + q, n)) for k, s, q, n in zip(brick, start, patch, dims, strict=True)]
                part = both[(slice(None), *(slice(f - s, e - s) for (f, e), s in zip(runs, start, strict=True)))]
                sent.append({"px": brick[0], "py": brick[1], "pz": brick[2], "at": [f - k * side for (f, _), k in zip(runs, brick, strict=True)], "shape": list(part.shape[1:]), "data": np.ascontiguousarray(part).tobytes()})
            out.append(sent)
        return pa.array(out, _ARROW_CUT)

    def join(bx, by, bz, nx, ny, nz, pieces):
        out = []
        for *at, a, b, c, parts in bricks._rows(bx, by, bz, nx, ny, nz, pieces):
            total = np.zeros((2, *bricks._sizes(at, (a, b, c), side)))
            for part in parts:
                where = tuple(slice(f, f + n) for f, n in zip(part["at"], part["shape"], strict=True))
                total[(slice(None), *where)] += np.frombuffer(part["data"]).reshape(2, *part["shape"])
            out.append(total.tobytes())
        return pa.array(out, pa.binary())

    dims = [F.first(n).alias(n) for n in bricks.DIMS]
    piece = F.struct("s.at", "s.shape", "s.data")
    at = ["px", "py", "pz"]
    lent = volume.select("volume_id", *bricks.DIMS, F.explode(F.arrow_udf(cut, _CUT)(*bricks.KEY[1:], *bricks.DIMS, "data")).alias("s"))
    lent = lent.select("volume_id", *(f"s.{c}" for c in at), *bricks.DIMS, piece.alias("piece"))
    whole = lent.groupBy("volume_id", *at).agg(*dims, F.collect_list("piece").alias("pieces"))  # as many as bricks meet a patch
    back = whole.select("volume_id", *bricks.DIMS, F.explode(F.arrow_udf(rate, _CUT)(*at, *bricks.DIMS, "pieces")).alias("s"))
    back = back.select("volume_id", *(F.col(f"s.{p}").alias(b) for p, b in zip(at, bricks.KEY[1:], strict=True)), *bricks.DIMS, F.struct("s.px", *(f"s.{c}" for c in ("at", "shape", "data"))).alias("piece"))
    whole = back.groupBy(*bricks.KEY).agg(*dims, F.collect_list("piece").alias("pieces"))  # as many as patches meet a brick
    done = whole.select(*bricks.KEY, *bricks.DIMS, F.lit(0.0).alias("reach"), F.arrow_udf(join, "binary")(*bricks.KEY[1:], *bricks.DIMS, "pieces").alias("data"))
    return bricks.bucketed(done)


def blended(volume: DataFrame, dims, patch, scorer, overlap: float = 0.25, sigma: float = 8.0, flips=FLIPS[:1], channels: int = 0, side: int = bricks.SIDE) -> DataFrame:
    """volume_id, x, y, z, p, w of the voxels of a volume (or of its channels), by score_bricks."""
    found = score_bricks(bricks.to_bricks(volume, dims, side=side, channels=channels), patch, scorer, overlap, sigma, flips, channels, side)
    return bricks.from_bricks(found, ("p", "w"), side).join(volume.select(*AT).distinct() if channels else volume.select(*AT), AT, "left_semi")


def sliding_window(volume: DataFrame, dims, patch, scorer, overlap: float = 0.25, threshold: float = 0.4, sigma: float = 8.0, flips=FLIPS[:1], least: int = 1, side: int = bricks.SIDE) -> tuple[DataFrame, DataFrame]:
    """The blended probability of dense volumes and the mask that reaches the threshold, without components of fewer than ``least`` voxels."""
    mixed = written(blended(z_score(volume), dims, patch, scorer, overlap, sigma, flips, side=side))
    probability = mixed.select(*AT, (F.col("p") / F.col("w")).alias("p"))
    mask = probability.where(F.col("p") >= threshold)
    return probability, mask if least <= 1 else remove_small(mask, dims, least)

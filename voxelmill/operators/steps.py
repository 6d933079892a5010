"""Whole steps around an injected scorer: extraction of a brain, segmentation, and the ensemble of several channels.

Each is a composition of the other operators; the scorer is a function of NumPy arrays, as in ``score``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import conform_dims, padded_dims
from ..session import written
from .elementwise import below, p99_normalise, z_score_nonzero
from .geometry import AT, centre_pad, centre_unpad, crop, grid, orient, orient_back, patch_voxels, place_back, resize_labels, resize_linear, spaced_dims
from .morphology import dilate, keep_largest_and_fill, remove_small
from .score import FLIPS, blended, score_patches, sliding_window
from .stats import bounding_box

#: Axes and flips from right-anterior-superior to left-inferior-anterior.
TO_LIA = ((0, 2, 1), (True, True, False))


def extract_brain(volume: DataFrame, dims, spacing, scorer, border: float = 1.0, target: float = 1.0, conform=conform_dims, grow: bool = False) -> DataFrame:
    """The mask (volume_id, x, y, z) of one dense volume whose scored distance to the brain lies below ``border``.

    Turned to LIA, resampled to ``target`` mm, cropped to its nonzero box, padded to the size that the scorer takes and normalised; the distance is
    taken back the same way, the largest component is kept and filled, and turned back. A volume of zeros gives an empty mask.
    """
    perm, flip = TO_LIA
    lia_dims, lia_spacing = [dims[p] for p in perm], [spacing[p] for p in perm]
    work = orient(volume.select(*AT, "value"), dims, perm, flip)
    resample = any(s != target for s in lia_spacing)
    work_dims = spaced_dims(lia_dims, lia_spacing, (target,) * 3) if resample else tuple(lia_dims)
    work = written(resize_linear(work, lia_dims, work_dims) if resample else work)
    box = bounding_box(work, work_dims).first()
    if box is None or box.empty:
        return volume.select(*AT).limit(0)
    start, end = (box.x0, box.y0, box.z0), (box.x1, box.y1, box.z1)
    size = tuple(b - a for a, b in zip(start, end, strict=True))
    fit = conform(size)
    padded = grid(work, fit).join(centre_pad(crop(work, start, end), size, fit), AT, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    whole = patch_voxels(p99_normalise(padded), fit, fit, 0.0)
    distance = score_patches(whole, fit, scorer).select(*AT, F.col("p").alias("value"))
    cropped = centre_unpad(distance, size, fit)
    border = border / target if resample else border
    if resample:
        back = resize_linear(place_back(cropped, start, work_dims, border + 1), work_dims, lia_dims)
        mask = below(back, border)
    else:
        mask = below(place_back(cropped, start, work_dims, border + 1), border)
    found = orient_back(keep_largest_and_fill(mask.select(*AT), lia_dims), dims, perm, flip).select(*AT)
    return dilate(found, dims, 1) if grow else found


def segment(volume: DataFrame, dims, spacing, scorer, patch, target=None, zyx: bool = False, threshold: float = 0.4, least: int = 1, overlap: float = 0.25, sigma: float = 8.0, flips=FLIPS[:1]) -> DataFrame:
    """The mask of dense volumes on their own grid, scored at ``target`` spacing (None, or None for an axis: its own) and, with ``zyx``, with axes in reverse order."""
    target = [s if t is None else t for s, t in zip(spacing, target or [None] * 3, strict=True)]
    work, work_dims = volume.select(*AT, "value"), tuple(dims)
    if list(target) != list(spacing):
        work_dims = spaced_dims(dims, spacing, target)
        work = resize_linear(work, dims, work_dims)
    turned = ((2, 1, 0), (False, False, False))
    scored_dims = work_dims[::-1] if zyx else work_dims
    scored = orient(work, work_dims, *turned) if zyx else work
    # Voxels that padding to the patch size adds are zeros of the patches.
    _, mask = sliding_window(scored, padded_dims(scored_dims, patch), patch, scorer, overlap, threshold, sigma, flips)
    mask = mask.select(*AT)
    mask = remove_small(mask, scored_dims, least) if least > 1 else mask
    mask = orient_back(mask, work_dims, *turned).select(*AT) if zyx else mask
    if work_dims != tuple(dims):
        mask = resize_labels(mask.withColumn("value", F.lit(1)), work_dims, dims).where("value = 1").select(*AT)
    return mask


def segment_channels(channels: DataFrame, dims, patch, scorer, count: int, classes: int = 1, overlap: float = 0.625, threshold: float = 0.5, least: int = 30, sigma: float = 8.0) -> DataFrame:
    """The mask of dense volumes of several channels (volume_id, channel, x, y, z, value), each normalised by its nonzero values.

    ``count`` is how many channels there are. The scorer maps channels by patch to logits of two classes by patch; ``classes`` is the class whose softmax counts.
    """
    own = F.concat_ws("#", "volume_id", F.col("channel").cast("string"))
    volumes = channels.select(own.alias("volume_id"), F.col("volume_id").alias("of"), "channel", "x", "y", "z", "value")
    normal = z_score_nonzero(volumes).select(F.col("of").alias("volume_id"), "channel", "x", "y", "z", "value")

    def probability(block):
        logits = scorer(block)
        e = np.exp(logits - logits.max(0))
        return e[classes] / np.maximum(e.sum(0), 1e-12)

    # Padding to the patch size adds zeros, which patches hold anyway.
    mixed = blended(normal, padded_dims(dims, patch), patch, probability, overlap, sigma, channels=count)
    mask = mixed.where((F.col("w") > 0) & (F.col("p") / F.col("w") >= threshold)).select(*AT)
    return remove_small(mask, dims, least) if least > 1 else mask

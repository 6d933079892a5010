"""Components and morphology of sparse masks (volume_id, x, y, z)."""

from __future__ import annotations

from functools import partial
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import bricks
from .geometry import AT, grid, linear_id
from .graph import components
from .stats import percentile_mask

_HALF = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def _shifted(mask: DataFrame, offsets, keep: list[str] = []) -> DataFrame:
    moves = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(o, ("dx", "dy", "dz"), strict=True))) for o in offsets)))
    out = mask.select(*AT, *keep, moves.alias("o"))
    return out.select("volume_id", *keep, *(F.col(c).alias(f"{c}0") for c in "xyz"), *((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "xyz"))


def _block_labels(x: np.ndarray, y: np.ndarray, z: np.ndarray, ids: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The least id of each voxel's component within one block: minima of the 3 x 3 x 3 surroundings, then those of the voxel that the minimum names, until nothing changes.

    ``start`` has for each voxel an id that is known to be of its component, such as that of a part of it.
    """
    x, y, z = (c - c.min() + 1 for c in (x, y, z))
    none = np.iinfo(np.int64).max
    label = np.full((x.max() + 2, y.max() + 2, z.max() + 2), none)
    order = np.sort(ids)
    rank = np.searchsorted(order, ids)
    label[x, y, z] = rank if start is None else np.searchsorted(order, start)
    best = np.empty(len(ids), np.int64)
    while True:
        around = label
        for axis in range(3):
            around = np.minimum(around, np.minimum(np.roll(around, 1, axis), np.roll(around, -1, axis)))
        new = around[x, y, z]
        best[rank] = new
        new = best[new]
        if np.array_equal(new, label[x, y, z]):
            return order[new]
        label[x, y, z] = new


def label_components(mask: DataFrame, dims, block: int = 32) -> DataFrame:
    """Adds ``component``: the least linear id of the voxel's component of 26 neighbours. ``dims`` are three numbers, or a table of each volume's own grid.

    Components are found within blocks of ``block`` voxels a side; then only voxels at the blocks' borders look for neighbours in other
    blocks, by an equality join on shifted coordinates, and star steps join the labels of blocks. Nodes are pairs of volume_id and label.
    """
    if isinstance(dims, DataFrame):
        own = mask.join(dims.select("volume_id", F.col("nx").alias("_nx"), F.col("ny").alias("_ny")), "volume_id")
        cells = own.withColumn("_id", (F.col("x") + F.col("_nx") * (F.col("y") + F.col("_ny") * F.col("z"))).cast("long")).drop("_nx", "_ny")
    else:
        cells = mask.withColumn("_id", linear_id(dims).cast("long"))
    cells = cells.withColumns({f"_b{c}": F.floor(F.col(c) / block).cast("int") for c in "xyz"})
    schema, columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mask.schema.fields), mask.columns

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, z, ids = (rows[c].to_numpy(np.int64) for c in ("x", "y", "z", "_id"))
        return rows[columns].assign(_l=_block_labels(x, y, z, ids))

    labelled = written(cells.groupBy("volume_id", "_bx", "_by", "_bz").applyInPandas(work, f"{schema}, _l long"))
    spot = lambda c: F.pmod(F.col(c), F.lit(block))
    edge = F.lit(False)
    for c in "xyz":
        edge = edge | (spot(c) == 0) | (spot(c) == block - 1)
    border = labelled.where(edge).select(*AT, "_l")
    away = F.lit(False)
    for c in "xyz":
        away = away | (F.floor(F.col(c) / block) != F.floor(F.col(f"{c}0") / block))
    near = _shifted(border, _HALF, ["_l"]).where(away).join(border.select(*AT, F.col("_l").alias("_m")), AT)
    node = lambda c: F.struct(F.col("volume_id").alias("v"), F.col(c).alias("i"))
    links = written(near.where("_l <> _m").select(node("_l").alias("a"), node("_m").alias("b")).distinct())
    if links.isEmpty():
        return labelled.withColumnRenamed("_l", "component")
    found = components(links).select(F.col("node.v").alias("volume_id"), F.col("node.i").alias("_l"), F.col("component.i").alias("component"))
    out = labelled.join(found, ["volume_id", "_l"], "left").withColumn("component", F.coalesce("component", "_l"))
    return out.select(*mask.columns, "component")


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("volume_id", "component").agg(F.count(F.lit(1)).alias("voxels"))


def component_summary(labelled: DataFrame) -> DataFrame:
    """Number of components, the largest and the five largest sizes as text. Sizes are counted, so that no list of all components is made."""
    counts = component_sizes(labelled).groupBy("volume_id", "voxels").agg(F.count(F.lit(1)).alias("c"))
    all_ = counts.groupBy("volume_id").agg(F.sum("c").cast("int").alias("components"), F.max("voxels").alias("largest"))
    rank = F.row_number().over(Window.partitionBy("volume_id").orderBy(F.desc("voxels")))
    five = counts.withColumn("k", rank).where("k <= 5").select("volume_id", F.explode(F.array_repeat("voxels", F.least("c", F.lit(5)).cast("int"))).alias("s"))
    five = five.groupBy("volume_id").agg(F.slice(F.sort_array(F.collect_list("s"), False), 1, 5).alias("s"))  # 25 at most
    return all_.join(five, "volume_id").select("volume_id", "components", "largest", F.array_join(F.transform("s", lambda n: n.cast("string")), ",").alias("largest_five"))


def remove_small(mask: DataFrame, dims, least: int) -> DataFrame:
    labelled = label_components(mask, dims)
    big = component_sizes(labelled).where(F.col("voxels") >= least)
    return labelled.join(big, ["volume_id", "component"], "left_semi").select(*mask.columns)


def complement(mask: DataFrame, dims) -> DataFrame:
    return grid(mask, dims).join(mask.select(*AT), AT, "left_anti")


def keep_largest_and_fill(mask: DataFrame, dims, always_fill: bool = False) -> DataFrame:
    """The largest component (ties: least voxel) with its holes filled; a mask of one component or none stays as it is."""
    labelled = label_components(mask, dims)
    sizes = component_sizes(labelled)
    per = sizes.groupBy("volume_id").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct((-F.col("voxels")).alias("n"), F.col("component").alias("c"))).alias("best"))
    largest = labelled.join(per, "volume_id").where(F.col("component") == F.col("best.c")).select(*AT, "k")
    outside = label_components(complement(largest, dims), dims)
    edge = F.lit(False)
    for c, n in zip("xyz", dims, strict=True):
        edge = edge | (F.col(c) == 0) | (F.col(c) == n - 1)
    open_ = outside.where(edge).select("volume_id", "component").distinct()
    holes = outside.join(open_, ["volume_id", "component"], "left_anti").select(*AT)
    if not always_fill:
        holes = holes.join(per.where("k > 1"), "volume_id", "left_semi")
    return largest.select(*AT).unionByName(holes)


def _dilated(block: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        grown = block.copy()
        for axis in (1, 2, 3):
            ahead, behind = (tuple(slice(*(ends if k == axis else (None, None))) for k in range(4)) for ends in ((1, None), (None, -1)))
            np.maximum(grown[ahead], block[behind], out=grown[ahead])
            np.maximum(grown[behind], block[ahead], out=grown[behind])
        block = grown
    return block


def dilate(mask: DataFrame, dims, radius: int = 1, side: int = bricks.SIDE) -> DataFrame:
    """Grows a mask by its 6 neighbours, radius times: bricks lend each other borders of that width, so a radius within a brick takes one exchange."""
    out = bricks.to_bricks(mask.select(*AT, F.lit(1.0).alias("value")), dims, side=side)
    while radius > 0:
        step = min(radius, side)
        out = bricks.around(out, step, partial(_dilated, times=step), side=side)
        radius -= step
    return bricks.from_bricks(out, side=side, nonzero=True).select(*AT)


def _voted(block: np.ndarray, votes: int) -> np.ndarray:
    total = block
    for axis in (1, 2, 3):
        total = total + np.roll(total, 1, axis) + np.roll(total, -1, axis)  # what wraps round stays in the halo
    return (total >= votes).astype(float)


def smooth(mask: DataFrame, dims, votes: int = 14, side: int = bricks.SIDE) -> DataFrame:
    """Majority of the 27 voxels around each voxel, cut at the border."""
    marked = bricks.to_bricks(mask.select(*AT, F.lit(1.0).alias("value")), dims, side=side)
    return bricks.from_bricks(bricks.around(marked, 1, partial(_voted, votes=votes), side=side), side=side, nonzero=True).select(*AT)


def threshold_and_clean(volume: DataFrame, dims, q: float, symmetric: bool = False, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Mask beyond the quantile without small components, and a row of raw, kept and removed voxel counts."""
    raw = percentile_mask(volume, q, symmetric)
    kept = raw if least <= 1 else remove_small(raw, dims, least)
    a, b = raw.agg(F.count(F.lit(1)).alias("raw_count")), kept.agg(F.count(F.lit(1)).alias("kept_count"))
    return kept, a.crossJoin(b).withColumn("removed_by_cluster", F.col("raw_count") - F.col("kept_count"))  # one row each

"""Components of a volume at many thresholds at once: a component tree by blocks, joined over their borders.

Within a block voxels are united in descending order of level, so a component at one threshold goes on from what it was at the next higher one. A block
gives a row for each component and threshold, and its border voxels with the names of their components at all thresholds that they
reach; names that touch over a border are merged for all thresholds in one run of star steps. No voxel is labelled once a threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .evaluate import scores
from .geometry import inside, linear_id
from .graph import components
from .morphology import _HALF, AT, _block_labels, _shifted

_PARTS = "volume_id string, level int, node long, n long, hits long, x int, y int, z int, names array<long>"
_ARROW = pa.schema([("volume_id", pa.string()), ("level", pa.int32()), *((c, pa.int64()) for c in ("node", "n", "hits")), *((c, pa.int32()) for c in "xyz"), ("names", pa.list_(pa.int64()))])


def nested_labels(x: np.ndarray, y: np.ndarray, z: np.ndarray, ids: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """For levels from 1 up the least id of each voxel's component among the voxels of that level and more, -1 for those below it."""
    top, out = int(level.max()), []
    labels = np.full(len(ids), -1, np.int64)
    for k in range(top, 0, -1):
        here = level >= k
        # A component of a higher level is one node from here on: its voxels start with its name.
        start = np.where(labels >= 0, labels, ids)
        found = np.full(len(ids), -1, np.int64)
        found[here] = _block_labels(x[here], y[here], z[here], ids[here], start[here])
        out.append(found)
        labels = found
    return out[::-1]


def component_tree(cells: DataFrame, dims, block: int = 32) -> DataFrame:
    """volume_id, level, component, n, hits: the components of the voxels of each level and more, for all levels from 1 up.

    cells: volume_id, x, y, z, level, hit (0 or 1). A component's name is its least linear id; its voxels are counted, and those that hit.
    """
    rows = cells.where("level > 0").withColumns({f"_b{c}": F.floor(F.col(c) / block).cast("int") for c in "xyz"}).withColumn("_id", linear_id(dims).cast("long"))

    def work(part: pa.Table) -> pa.Table:
        x, y, z, ids, level, hit = (part[c].to_numpy().astype(np.int64) for c in ("x", "y", "z", "_id", "level", "hit"))
        named = nested_labels(x, y, z, ids, level)
        found = []
        for k, labels in enumerate(named, 1):
            here = labels >= 0
            node, at = np.unique(labels[here], return_inverse=True)
            found.append((np.full(len(node), k), node, np.bincount(at), np.bincount(at, hit[here])))
        nodes = [np.concatenate(v).astype(np.int64) for v in zip(*found, strict=True)]
        edge = np.zeros(len(ids), bool)
        for c in (x, y, z):
            edge |= (c % block == 0) | (c % block == block - 1)
        at = np.flatnonzero(edge)
        border = [x[at], y[at], z[at], [[int(f[i]) for f in named[: level[i]]] for i in at]]
        none = lambda n: [None] * n
        columns = [none(0) + v.tolist() + none(len(at)) for v in nodes] + [none(len(nodes[0])) + list(v) for v in border]
        name = [part["volume_id"][0].as_py()] * (len(nodes[0]) + len(at))
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip([name, *columns], _ARROW, strict=True)], schema=_ARROW)

    parts = written(rows.select("volume_id", "_bx", "_by", "_bz", "x", "y", "z", "_id", "level", "hit").groupBy("volume_id", "_bx", "_by", "_bz").applyInArrow(work, _PARTS))
    border = parts.where("names is not null").select(*AT, "names")
    away = F.lit(False)
    for c in "xyz":
        away = away | (F.floor(F.col(c) / block) != F.floor(F.col(f"{c}0") / block))
    near = _shifted(border, _HALF, ["names"]).where(away & inside(dims, "x", "y", "z")).join(border.select(*AT, F.col("names").alias("_m")), AT)
    # Neighbours belong together at every level that both reach.
    pairs = F.transform(F.sequence(F.lit(1), F.least(F.size("names"), F.size("_m"))), lambda k: F.struct(k.alias("level"), F.get("names", k - 1).alias("a"), F.get("_m", k - 1).alias("b")))
    touch = near.select("volume_id", F.explode(pairs).alias("p")).select("volume_id", "p.*").where("a <> b").distinct()
    node = lambda c: F.struct(F.col("volume_id").alias("v"), F.col("level").alias("l"), F.col(c).alias("i"))
    links = written(touch.select(node("a").alias("a"), node("b").alias("b")))
    nodes = parts.where("names is null").select("volume_id", "level", "node", "n", "hits")
    if not links.isEmpty():
        found = components(links).select(F.col("node.v").alias("volume_id"), F.col("node.l").alias("level"), F.col("node.i").alias("node"), F.col("component.i").alias("component"))
        nodes = nodes.join(found, ["volume_id", "level", "node"], "left").withColumn("node", F.coalesce("component", "node"))
    return nodes.groupBy("volume_id", "level", F.col("node").alias("component")).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def threshold_sweep(probability: DataFrame, truth: DataFrame, dims, thresholds: list[float], least: int = 1, block: int = 32) -> DataFrame:
    """Scores of each volume at each threshold after components of fewer than ``least`` voxels (26 neighbours) are removed.

    probability: volume_id, x, y, z, p; truth: volume_id, x, y, z. All volumes of either have a row for each threshold. Voxels are counted in one
    pass for all thresholds.
    """
    if not thresholds:
        raise ValueError("at least one threshold is needed")
    levels = sorted(set(thresholds))
    marked = truth.select(*AT).distinct()
    reached = F.size(F.filter(F.array(*map(F.lit, levels)), lambda v: v <= F.col("p")))
    cells = probability.select(*AT, reached.alias("level")).where("level > 0").join(marked.withColumn("_t", F.lit(1)), AT, "left")
    tree = component_tree(cells.select(*AT, "level", F.coalesce("_t", F.lit(0)).alias("hit")), dims, block)
    kept = tree.where(F.col("n") >= least).groupBy("volume_id", "level").agg(F.sum("n").alias("predicted"), F.sum("hits").alias("tp"))
    volumes = probability.select("volume_id").union(marked.select("volume_id")).distinct()
    totals = volumes.join(marked.groupBy("volume_id").agg(F.count(F.lit(1)).alias("t")), "volume_id", "left")
    every = totals.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(len(levels)))))
    out = every.join(kept, ["volume_id", "level"], "left").fillna(0, ["t", "predicted", "tp"])
    threshold = F.get(F.array(*map(F.lit, levels)), F.col("level") - 1).alias("threshold")
    return scores(out.select("volume_id", threshold, "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn")))

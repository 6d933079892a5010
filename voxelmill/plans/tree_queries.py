"""Queries over the component tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree
from ..session import written
from . import substrate as S
from .registry import query
from .substrate import DIMS, VOL, micro
from .substrate import micro_sql as M

_LEVELS = [0.5, 0.6, 0.7, 0.8]
_TREE = f"""WITH RECURSIVE {VOL}, prob AS (SELECT *, value / (SELECT max(value) FROM vol) AS p FROM vol), truth AS (SELECT vid FROM vol WHERE n > (SELECT avg(n) + stddev_pop(n) FROM vol)),
high AS (SELECT CAST(thr AS DOUBLE) AS thr, vid, x, y, z FROM prob, (SELECT unnest({_LEVELS}) AS thr) WHERE p >= CAST(thr AS DOUBLE)),
near AS (SELECT a.thr, a.vid AS a, b.vid AS b FROM high a JOIN high b ON a.thr = b.thr AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
reach AS (SELECT thr, vid AS root, vid FROM high UNION SELECT near.thr, root, b FROM reach JOIN near ON near.thr = reach.thr AND a = vid),
comp AS (SELECT thr, vid, min(root) AS component FROM reach GROUP BY 1, 2), sized AS (SELECT thr, component, count(*) AS n FROM comp GROUP BY 1, 2),
kept AS (SELECT thr, count(*) AS predicted, count(truth.vid) AS tp FROM comp JOIN sized USING (thr, component) LEFT JOIN truth USING (vid) WHERE n >= 4 GROUP BY 1),
every AS (SELECT CAST(unnest({_LEVELS}) AS DOUBLE) AS threshold), s AS (SELECT threshold, coalesce(tp, 0) AS tp, coalesce(predicted - tp, 0) AS fp, (SELECT count(*) FROM truth) - coalesce(tp, 0) AS fn FROM every LEFT JOIN kept ON thr = threshold)"""


def _inputs(spark, sf):
    v = written(S.volume(spark, sf))
    top = F.broadcast(v.agg(F.max("value").alias("top")))  # one row
    return v.crossJoin(top).select("volume_id", "x", "y", "z", (F.col("value") / F.col("top")).alias("p")), S.mask(spark, sf)


@query(f"{_TREE} SELECT threshold, tp, fp, fn, {M('2 * tp / (2 * tp + fp + fn)')} AS dice FROM s")
def rpt4_sweep_without_small(spark, sf):
    """RPT-4 with MOR-2: scores at each threshold after components of fewer than four voxels are removed, over blocks of 8 voxels a side."""
    out = tree.threshold_sweep(*_inputs(spark, sf), DIMS, _LEVELS, 4, block=8)
    return out.select("threshold", "tp", "fp", "fn", micro(F.col("dice")).alias("dice"))


@query(f"{_TREE} SELECT CAST(list_position({_LEVELS}, thr) AS INT) AS level, CAST(component AS BIGINT) AS component, n FROM sized")
def mor1_component_tree(spark, sf):
    """The components at all thresholds."""
    p, _ = _inputs(spark, sf)
    level = F.size(F.filter(F.array(*map(F.lit, _LEVELS)), lambda v: v <= F.col("p")))
    return tree.component_tree(p.withColumn("level", level).withColumn("hit", F.lit(0)), DIMS, 8).select("level", "component", "n")

"""The report on candidates that were predicted on other grids than the truth's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, grids
from ..session import written
from . import substrate as S
from .grid_queries import _NEAREST
from .registry import query
from .substrate import PLACED, micro
from .substrate import micro_sql as M

_VIEW = """w AS (SELECT volume_id, CASE flag WHEN 'N' THEN -6 ELSE 0 END AS x0, CASE flag WHEN 'A' THEN 10 WHEN 'N' THEN 12 ELSE 12.5 END::DOUBLE AS x1, CASE flag WHEN 'A' THEN -3 ELSE 1 END AS y0, CASE flag WHEN 'N' THEN 23 ELSE 21 END AS y1, CASE flag WHEN 'A' THEN 0.25 WHEN 'N' THEN 0 ELSE -4 END::DOUBLE AS z0, CASE flag WHEN 'A' THEN 12.25 WHEN 'N' THEN 9 ELSE 10 END::DOUBLE AS z1 FROM gm),
seen AS (SELECT volume_id, greatest(0, least(x1, 16.05) - greatest(x0, 0.3)) * greatest(0, least(y1, 21.2) - greatest(y0, 0.2)) * greatest(0, least(z1, 14.4) - greatest(z0, 0.4)) / (15.75::DOUBLE * 21 * 14) AS fov FROM w)"""


@query(f"""WITH RECURSIVE {PLACED}, {_VIEW}, means AS (SELECT volume_id, avg(value) AS mv, avg(n) AS mn FROM gv GROUP BY 1),
hit AS (SELECT p.volume_id, p.x, p.y, p.z, p.x + 7 * (p.y + 7 * p.z) AS vid, value, n, mv, mn FROM placed p JOIN gv v ON p.volume_id = v.volume_id AND {_NEAREST} JOIN means m ON m.volume_id = p.volume_id),
mode AS (SELECT unnest(['bright', 'top', 'none']) AS mode), truth AS (SELECT * FROM hit WHERE n > mn),
pred AS (SELECT mode, hit.* FROM hit, mode WHERE (mode = 'bright' AND value > mv) OR (mode = 'top' AND value > 1.5 * mv)),
near AS (SELECT a.volume_id, a.mode, a.vid AS a, b.vid AS b FROM pred a JOIN pred b ON a.volume_id = b.volume_id AND a.mode = b.mode AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
reach AS (SELECT volume_id, mode, vid AS root, vid FROM pred UNION SELECT near.volume_id, near.mode, root, b FROM reach JOIN near ON near.volume_id = reach.volume_id AND near.mode = reach.mode AND a = vid),
comp AS (SELECT volume_id, mode, vid, min(root) AS component FROM reach GROUP BY 1, 2, 3), sized AS (SELECT volume_id, mode, component, count(*) AS n FROM comp GROUP BY 1, 2, 3),
parts AS (SELECT volume_id, mode, count(*) AS components, max(n) AS largest, array_to_string(list_reverse_sort(list(n))[1:5], ',') AS largest_five FROM sized GROUP BY 1, 2),
places AS (SELECT volume_id, mode, count(*) AS k, avg(x) AS cx, min(y) AS y0, max(z) + 1 AS z1 FROM pred GROUP BY 1, 2),
agree AS (SELECT p.volume_id, p.mode, count(*) AS tp FROM pred p JOIN truth t USING (volume_id, vid) GROUP BY 1, 2), t AS (SELECT volume_id, count(*) AS t FROM truth GROUP BY 1),
s AS (SELECT gm.volume_id, mode, coalesce(tp, 0) AS tp, coalesce(k, 0) - coalesce(tp, 0) AS fp, coalesce(t, 0) - coalesce(tp, 0) AS fn, coalesce(components, 0) AS components, coalesce(largest, 0) AS largest, largest_five, cx, y0, z1 FROM gm CROSS JOIN mode LEFT JOIN t USING (volume_id) LEFT JOIN agree USING (volume_id, mode) LEFT JOIN parts USING (volume_id, mode) LEFT JOIN places USING (volume_id, mode)),
d AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END::DOUBLE AS dice FROM s)
SELECT d.volume_id AS "case", d.mode, d.tp, d.fp, d.fn, {M('d.dice')} AS dice, CAST(d.components AS INT) AS components, d.largest, d.largest_five, {M('d.cx')} AS cx, d.y0, d.z1, {M('fov')} AS fov_overlap, {M('d.dice - r.dice')} AS gap, d.dice - r.dice >= -0.01 AS reached
FROM d JOIN seen USING (volume_id) LEFT JOIN d r ON r.volume_id = d.volume_id AND r.mode = 'bright' AND d.mode <> 'bright'""")
def rpt5_candidate_report(spark, sf):
    """RPT-5 with AGG-12 and GEO-18: three modes on three kinds of grids, scored on the target grid against where many line items are."""
    v = written(S.grid_volumes(spark, sf))
    v = written(v.join(v.groupBy("volume_id").agg(F.avg("value").alias("mv"), F.avg("n").alias("mn")), "volume_id"))
    meta = written(S.grid_meta(v))
    target = grids.to_grid(meta, *S.TARGET)
    mode = lambda name, rule: v.where(rule).select(F.col("volume_id").alias("case"), F.lit(name).alias("mode"), "x", "y", "z")
    candidates = meta.withColumnRenamed("volume_id", "case").withColumn("mode", F.explode(F.array(*map(F.lit, ("bright", "top", "none")))))
    truth = grids.resample_mask(v.where("n > mn"), meta, target).withColumnRenamed("volume_id", "case")
    out = evaluate.candidate_report(mode("bright", "value > mv").unionByName(mode("top", "value > 1.5 * mv")), candidates, truth, target.withColumnRenamed("volume_id", "case"), "bright")
    figures = [micro(F.col(c)).alias(c) for c in ("dice", "cx", "fov_overlap", "gap")]
    return out.select("case", "mode", "tp", "fp", "fn", "components", "largest", "largest_five", "y0", "z1", "reached", *figures)

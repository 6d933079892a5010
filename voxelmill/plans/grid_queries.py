"""Queries over volumes of different grids, each with its own dims and affine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, stats
from ..session import written
from . import substrate as S
from .registry import query
from .substrate import GRIDS, PLACED, micro
from .substrate import micro_sql as M

AT = ["volume_id", "x", "y", "z"]
_NEAREST = "floor(sx + 0.5) = v.x AND floor(sy + 0.5) = v.y AND floor(sz + 0.5) = v.z"


def _volumes(spark, sf):
    v = written(S.grid_volumes(spark, sf))
    return v, S.grid_meta(v)


def _bright(v):
    """Voxels above the mean of their volume."""
    mean = v.groupBy("volume_id").agg(F.avg("value").alias("mean"))
    return v.join(mean, "volume_id").where(F.col("value") > F.col("mean")).select(*AT, "value")


_BRIGHT = "bright AS (SELECT gv.* FROM gv JOIN (SELECT volume_id, avg(value) AS mean FROM gv GROUP BY 1) USING (volume_id) WHERE value > mean)"


@query(f"WITH {PLACED} SELECT p.volume_id, p.x, p.y, p.z, coalesce(v.value, 0) AS value FROM placed p LEFT JOIN gv v ON p.volume_id = v.volume_id AND {_NEAREST}")
def geo1_resample_grids(spark, sf):
    """GEO-1: volumes of three grids onto one grid of another spacing, nearest."""
    v, meta = _volumes(spark, sf)
    return grids.resample_nearest(v, meta, grids.to_grid(meta, *S.TARGET))


@query(f"WITH {PLACED} SELECT p.volume_id, p.x, p.y, p.z, {M('coalesce(sum((1 - abs(sx - v.x)) * (1 - abs(sy - v.y)) * (1 - abs(sz - v.z)) * v.value), 0)')} AS value FROM placed p LEFT JOIN gv v ON p.volume_id = v.volume_id AND abs(sx - v.x) < 1 AND abs(sy - v.y) < 1 AND abs(sz - v.z) < 1 GROUP BY ALL")
def geo2_resample_grids(spark, sf):
    """GEO-2: the same, trilinear."""
    v, meta = _volumes(spark, sf)
    out = grids.resample_linear(v, meta, grids.to_grid(meta, *S.TARGET))
    return out.withColumn("value", micro(F.col("value")))


@query(f"WITH {PLACED}, {_BRIGHT} SELECT p.volume_id, p.x, p.y, p.z FROM placed p JOIN bright v ON p.volume_id = v.volume_id AND {_NEAREST}")
def geo19_sparse_masks(spark, sf):
    """GEO-19: masks onto the other grid, from the preimages of their voxels alone."""
    v, meta = _volumes(spark, sf)
    return grids.resample_mask(_bright(v), meta, grids.to_grid(meta, *S.TARGET))


@query(f"WITH {GRIDS} SELECT volume_id, x, y, z FROM gv JOIN (SELECT volume_id, quantile_cont(abs(value), 0.8) AS cut FROM gv GROUP BY 1) USING (volume_id) WHERE value > cut")
def prj2_masks_of_volumes(spark, sf):
    """AGG-5, PRJ-2: each volume's own cutoff."""
    v = S.grid_volumes(spark, sf)
    return stats.percentile_mask(v.select(*AT, "value"), 0.8).select(*AT)


@query(f"WITH {GRIDS}, {_BRIGHT} SELECT volume_id, count(*) AS n, {M('avg(x)')} AS cx, {M('avg(z)')} AS cz, {M('covar_pop(x, y)')} AS cxy, {M('covar_pop(y, y)')} AS cyy FROM bright GROUP BY 1")
def agg7_moments_of_volumes(spark, sf):
    """AGG-7, AGG-8: centroid and covariance of each volume's mask."""
    v, _ = _volumes(spark, sf)
    m = stats.moments(_bright(v))
    return m.select("volume_id", "n", *(micro(F.col(c)).alias(c) for c in ("cx", "cz", "cxy", "cyy")))


_STRONG = "strong AS (SELECT * FROM gv WHERE value > 0.8 * (SELECT max(value) FROM gv))"


def _strong(v):
    top = v.agg(F.max("value").alias("top"))
    return v.crossJoin(F.broadcast(top)).where(F.col("value") > 0.8 * F.col("top")).drop("top")  # one row


@query(f"WITH {GRIDS}, {_STRONG}, b AS (SELECT volume_id, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS \"by\", min(z) AS az, max(z) AS bz FROM strong GROUP BY 1) SELECT gm.volume_id, ax IS NULL AS empty, greatest(0, coalesce(ax - 1, 0)) AS x0, least(nx, coalesce(bx + 2, nx)) AS x1, greatest(0, coalesce(ay - 1, 0)) AS y0, least(ny, coalesce(\"by\" + 2, ny)) AS y1, greatest(0, coalesce(az - 1, 0)) AS z0, least(nz, coalesce(bz + 2, nz)) AS z1 FROM gm LEFT JOIN b USING (volume_id)")
def agg10_boxes_of_volumes(spark, sf):
    """AGG-9, AGG-10: boxes with a margin, clamped to each volume's grid; the whole grid where nothing is strong."""
    v, meta = _volumes(spark, sf)
    return grids.boxes(_strong(v), meta, 1, True, True)


@query(f"WITH {GRIDS}, {_BRIGHT}, b AS (SELECT volume_id, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS \"by\", min(z) AS az, max(z) AS bz FROM bright WHERE x % 3 <> 0 AND y > 2 GROUP BY 1), c AS (SELECT volume_id, nx, ny, nz, unnest(range(nx * ny * nz)) AS i FROM gm), d AS (SELECT volume_id, CAST(i % nx AS INT) AS x, CAST(i // nx % ny AS INT) AS y, CAST(i // (nx * ny) AS INT) AS z FROM c) SELECT d.volume_id, d.x, d.y, d.z, coalesce(CASE WHEN x BETWEEN ax AND bx AND y BETWEEN ay AND \"by\" AND z BETWEEN az AND bz THEN value END, -1) AS value FROM d LEFT JOIN b USING (volume_id) LEFT JOIN gv USING (volume_id, x, y, z)")
def geo7_crop_and_place_grids(spark, sf):
    """GEO-6, GEO-7: each volume cropped to its own box and put back on its own grid."""
    v, meta = _volumes(spark, sf)
    found = grids.boxes(_bright(v).where("x % 3 <> 0 and y > 2"), meta)
    return grids.place_back(grids.crop(v.select(*AT, "value"), found), found, meta, -1.0)


@query(f"WITH {GRIDS} SELECT volume_id, x + (16 - nx) // 2 AS x, y + CASE WHEN ny >= 11 THEN -((ny - 11) // 2) ELSE (11 - ny) // 2 END AS y, z + (10 - nz) // 2 AS z, value FROM gv WHERE y + CASE WHEN ny >= 11 THEN -((ny - 11) // 2) ELSE (11 - ny) // 2 END BETWEEN 0 AND 10")
def geo8_centre_grids(spark, sf):
    """GEO-8, GEO-9: each volume in the middle of one grid, which is larger along some axes and smaller along others."""
    v, meta = _volumes(spark, sf)
    return grids.centre(v.select(*AT, "value"), meta, grids.to_grid(meta, (16, 11, 10), S.TARGET[1]))


@query(f"WITH {GRIDS} SELECT volume_id, CASE flag WHEN 'A' THEN x WHEN 'N' THEN nx - 1 - x ELSE y END AS x, CASE flag WHEN 'R' THEN z ELSE y END AS y, CASE flag WHEN 'R' THEN nx - 1 - x ELSE z END AS z, CASE flag WHEN 'A' THEN {M('1.0 * x')} WHEN 'N' THEN {M('12 - 1.5 * x')} ELSE {M('1.25 * y')} END AS wx, CASE flag WHEN 'A' THEN {M('0.25 + 1.5 * z')} WHEN 'N' THEN {M('1.0 * z')} ELSE {M('10.0 - x')} END AS wz FROM gv")
def geo10_orient_grids(spark, sf):
    """GEO-10..12: axes along the world's, and the turned grids' affines, which leave each voxel at its place (wx, wz)."""
    v, meta = _volumes(spark, sf)
    turned = grids.orient(v.select(*AT), meta).join(grids.oriented_meta(meta), "volume_id")
    wx, _, wz = grids.image(F.col("affine"), *(F.col(c) for c in "xyz"))
    return turned.select(*AT, micro(wx).alias("wx"), micro(wz).alias("wz"))


@query(f"WITH {GRIDS} SELECT volume_id, x, y, z, value FROM gv")
def geo12_orient_back_grids(spark, sf):
    """GEO-12: turned and turned back."""
    v, meta = _volumes(spark, sf)
    return grids.orient_back(grids.orient(v.select(*AT, "value"), meta), meta)


@query(f"""WITH {GRIDS}, {_STRONG}, b AS (SELECT volume_id, 15 * (max(x) - min(x)) + 1 AS bx, 15 * (max(y) - min(y)) + 1 AS "by", 15 * (max(z) - min(z)) + 1 AS bz FROM strong GROUP BY 1),
s AS (SELECT gm.*, CASE flag WHEN 'N' THEN 1.5 ELSE 1 END::DOUBLE AS s1, CASE flag WHEN 'R' THEN 1.25 ELSE 2 END::DOUBLE AS s2, CASE flag WHEN 'A' THEN 1.5 WHEN 'N' THEN 1 ELSE 2 END::DOUBLE AS s3 FROM gm)
SELECT volume_id, {M('CASE WHEN bx IS NULL THEN 1 ELSE greatest(1.0, least(2.0, least(15 * nx * s1, 15 * ny * s2, 15 * nz * s3) / 48, greatest(bx * s1, "by" * s2, bz * s3) / 191)) END')} AS spacing FROM s LEFT JOIN b USING (volume_id)""")
def geo17_target_spacings(spark, sf):
    """GEO-17 on grids of some 150 voxels a side, whose boxes need from 1 to 2 mm."""
    v, meta = _volumes(spark, sf)
    wide = meta.withColumns({n: 15 * F.col(n) for n in grids.DIMS})
    far = _strong(v).withColumns({c: 15 * F.col(c) for c in "xyz"})
    out = grids.target_spacing(grids.boxes(far, wide), wide)
    return out.select("volume_id", micro(F.col("spacing")).alias("spacing"))


@query(f"""WITH {GRIDS}, w AS (SELECT volume_id, CASE flag WHEN 'N' THEN -6 ELSE 0 END AS x0, CASE flag WHEN 'A' THEN 10 WHEN 'N' THEN 12 ELSE 12.5 END::DOUBLE AS x1, CASE flag WHEN 'A' THEN -3 ELSE 1 END AS y0, CASE flag WHEN 'N' THEN 23 ELSE 21 END AS y1, CASE flag WHEN 'A' THEN 0.25 WHEN 'N' THEN 0 ELSE -4 END::DOUBLE AS z0, CASE flag WHEN 'A' THEN 12.25 WHEN 'N' THEN 9 ELSE 10 END::DOUBLE AS z1 FROM gm),
o AS (SELECT volume_id, greatest(0, least(x1, 16.05) - greatest(x0, 0.3)) * greatest(0, least(y1, 21.2) - greatest(y0, 0.2)) * greatest(0, least(z1, 14.4) - greatest(z0, 0.4)) / (15.75::DOUBLE * 21 * 14) AS o FROM w)
SELECT volume_id, {M('o')} AS overlap, false AS same_grid, true AS warned FROM o UNION ALL SELECT volume_id || ' itself', 1000000, true, false FROM gm""")
def geo18_views(spark, sf):
    """GEO-18, GEO-20: each grid against the target's and against itself."""
    _, meta = _volumes(spark, sf)
    itself = meta.withColumn("volume_id", F.concat("volume_id", F.lit(" itself")))
    out = grids.view_overlap(meta.unionByName(itself), grids.to_grid(meta, *S.TARGET).unionByName(itself), ["volume_id"])
    return out.select("volume_id", micro(F.col("overlap")).alias("overlap"), "same_grid", F.col("warning").isNotNull().alias("warned"))

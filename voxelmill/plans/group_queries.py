"""Queries over many volumes or subjects at once: principal axes, stored states, table functions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import axes, connectome, grids
from ..session import new_folder, written
from . import substrate as S
from .grid_queries import _BRIGHT, _bright
from .queries import _Z
from .registry import query
from .substrate import GRIDS, micro
from .substrate import micro_sql as M


@query(f"{_Z} SELECT source, target, count(*) AS n, {M('avg(z)')} AS mean_z, {M('avg(z) / greatest(stddev_samp(z) / sqrt(count(*)), 1e-6)')} AS t FROM z GROUP BY 1, 2")
def agg27_stored_state(spark, sf):
    """AGG-27: two runs of subjects stored one after the other, the second one twice, give the t of all subjects."""
    folder, pair = new_folder(spark, "state"), ["source", "target"]
    series = S.series(spark, sf)
    for run, some in (("first", "subject < 3"), ("second", "subject >= 3"), ("second", "subject >= 3")):
        connectome.add_run(connectome.pair_state(connectome.subject_z(series.where(some)), pair), folder, run)
    out = connectome.state_t(connectome.stored_state(spark, folder, pair), pair)
    return out.select(*pair, "n", micro(F.col("mean_z")).alias("mean_z"), micro(F.col("t")).alias("t"))


_COV = f"WITH {GRIDS}, {_BRIGHT}, c AS (SELECT volume_id, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM bright GROUP BY 1)"


@query(f"{_COV} SELECT volume_id, n, {M('xx + yy + zz')} AS trace, {M('xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)')} AS det, true AS solved, true AS square, true AS falling FROM c")
def reg2_principal_axes(spark, sf):
    """REG-1, REG-2: eigenvalues and axes of every volume's mask: their sum, their product, and that each axis is one."""
    v = _bright(written(S.grid_volumes(spark, sf)))
    found = axes.principal_axes(v).join(axes.moments(v).drop("n"), "volume_id")
    e = F.col("axes")
    row = lambda *c: F.array(*map(F.col, c))
    cov = [row("cxx", "cxy", "cxz"), row("cxy", "cyy", "cyz"), row("cxz", "cyz", "czz")]
    near = lambda a, b: F.abs(a - b) < 1e-9 * (1 + F.abs(b))
    every = lambda parts: F.forall(F.array(*parts), lambda b: b)
    solved = every(near(axes._dot(cov[i], e[k]["axis"]), e[k]["value"] * e[k]["axis"][i]) for k in range(3) for i in range(3))
    square = every(near(axes._dot(e[a]["axis"], e[b]["axis"]), F.lit(float(a == b))) for a in range(3) for b in range(3))
    falling = (e[0]["value"] >= e[1]["value"]) & (e[1]["value"] >= e[2]["value"])
    product = e[0]["value"] * e[1]["value"] * e[2]["value"]
    return found.select("volume_id", "n", micro(e[0]["value"] + e[1]["value"] + e[2]["value"]).alias("trace"), micro(product).alias("det"), solved.alias("solved"), square.alias("square"), falling.alias("falling"))


@query(f"WITH {GRIDS}, {_BRIGHT} SELECT volume_id, {M('avg(x)')} AS cx, {M('avg(y)')} AS cy, {M('avg(z)')} AS cz, 1 AS turns FROM bright GROUP BY 1")
def reg3_prealign(spark, sf):
    """REG-3: the rigid maps from each volume's mask to itself, moved and turned by a right angle: they take its middle back, and are rotations."""
    v = written(_bright(written(S.grid_volumes(spark, sf))).select("volume_id", "x", "y", "z"))
    moved = v.select("volume_id", (20 - F.col("y")).alias("x"), (F.col("x") + 3).alias("y"), (F.col("z") - 4).alias("z"))
    fixed = axes.principal_axes(moved)
    maps = axes.prealign(fixed, axes.principal_axes(v), ["volume_id"]).join(fixed.select("volume_id", "mean"), "volume_id")
    at = grids.image(F.col("affine"), *(F.col("mean")[k] for k in range(3)))
    det = axes._det([[F.col("affine")[i][j] for j in range(3)] for i in range(3)])
    return maps.select("volume_id", *(micro(c + 1e-10).alias(n) for c, n in zip(at, ("cx", "cy", "cz"), strict=True)), F.round(det).cast("int").alias("turns"))


@query(f"""WITH {GRIDS}, {_BRIGHT}, b AS (SELECT volume_id, count(*) AS n, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, min(z) AS z0, max(z) + 1 AS z1 FROM bright GROUP BY 1),
s AS (SELECT CAST(n AS INT) AS n, unnest(CASE WHEN n <= 5 THEN [0] WHEN n <= 9 THEN [0, n - 5] WHEN n <= 13 THEN [0, 4, n - 5] ELSE [0, 4, 8, n - 5] END) AS p FROM range(1, 15) t(n)),
p AS (SELECT volume_id, b.n, x0 + a.p AS px, y0 + c.p AS py, z0 + d.p AS pz FROM b JOIN s a ON a.n = x1 - x0 JOIN s c ON c.n = y1 - y0 JOIN s d ON d.n = z1 - z0)
SELECT p.volume_id, any_value(p.n) AS n, CAST(px AS INT) AS px, CAST(py AS INT) AS py, CAST(pz AS INT) AS pz, count(v.volume_id) AS voxels FROM p LEFT JOIN bright v ON v.volume_id = p.volume_id AND v.x >= px AND v.x < px + 5 AND v.y >= py AND v.y < py + 5 AND v.z >= pz AND v.z < pz + 5 GROUP BY p.volume_id, px, py, pz""")
def geo15_patches_in_sql(spark, sf):
    """GEO-15, AGG-9 in SQL alone: boxes of masks by a table function over partitions, patches of five voxels over each box, and what each holds."""
    tables.register(spark)
    _bright(written(S.grid_volumes(spark, sf))).createOrReplaceTempView("bright_voxels")
    return spark.sql(
        """
        WITH parts AS (SELECT * FROM voxel_box(TABLE(SELECT volume_id, x, y, z FROM bright_voxels) PARTITION BY volume_id)),
        boxes AS (SELECT volume_id, sum(n) AS n, min(x0) AS x0, min(y0) AS y0, min(z0) AS z0, max(x1) AS x1, max(y1) AS y1, max(z1) AS z1 FROM parts GROUP BY volume_id),
        patches AS (SELECT volume_id, n, x0 + px AS px, y0 + py AS py, z0 + pz AS pz FROM boxes, LATERAL voxel_patches(x1 - x0, y1 - y0, z1 - z0, 5, 0.25D))
        SELECT p.volume_id, any_value(p.n) AS n, px, py, pz, count(v.volume_id) AS voxels FROM patches p
        LEFT JOIN bright_voxels v ON v.volume_id = p.volume_id AND v.x >= px AND v.x < px + 5 AND v.y >= py AND v.y < py + 5 AND v.z >= pz AND v.z < pz + 5
        GROUP BY p.volume_id, px, py, pz
        """
    )

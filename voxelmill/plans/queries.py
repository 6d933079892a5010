"""The registered queries, each with SQL for the oracle where it can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import connect, connectome, elementwise, evaluate, geometry, morphology, overlap, rank, registration, score, stats, steps
from ..session import new_folder, written
from ..sources import nifti, pack as packs
from . import substrate as S
from .registry import QUERIES, SQL, query
from .substrate import CASES, DIMS, MASK, OVERLAP, PACK, SERIES, VOL, micro
from .substrate import micro_sql as M

def _ones(df: DataFrame) -> DataFrame:
    return df.select("x", "y", "z")


# Overlap


@query(f"WITH {OVERLAP} SELECT label, parcel_size, voxels, {M('fp')} AS of_parcel, {M('fl')} AS of_lesion FROM parcels")
def agg1_parcel_overlap(spark, sf):
    out = overlap.parcel_overlap(S.mask(spark, sf), S.atlas(spark))
    return out.select("label", "parcel_size", "voxels", micro(F.col("fraction_of_parcel")).alias("of_parcel"), micro(F.col("fraction_of_lesion")).alias("of_lesion"))


@query(f"WITH {OVERLAP} SELECT CAST(sum(voxels) AS BIGINT) AS total_voxels, CAST(sum(voxels) FILTER (WHERE label = 0) AS BIGINT) AS outside_voxels, CAST(sum(voxels) FILTER (WHERE label <> 0) AS BIGINT) AS assigned_voxels FROM hits")
def rpt6_coverage(spark, sf):
    return overlap.overlap_totals(S.mask(spark, sf), S.atlas(spark))


@query(f"WITH {OVERLAP} SELECT network, voxels, {M('fraction')} AS fraction, array_to_string(parcels, ';') AS parcels FROM summary ORDER BY voxels DESC, network")
def agg2_network_rollup(spark, sf):
    out = overlap.network_rollup(overlap.parcel_overlap(S.mask(spark, sf), S.atlas(spark)), S.names(spark, sf))
    text = F.array_join(F.transform("parcels", lambda p: p.cast("string")), ";")
    return overlap.order_networks(out).select("network", "voxels", micro(F.col("fraction")).alias("fraction"), text.alias("parcels"))


@query(f"WITH {OVERLAP} SELECT coalesce(network, 'Unassigned') AS network, label, CAST(sum(voxels) AS BIGINT) AS voxels FROM parcels LEFT JOIN names USING (label) GROUP BY ROLLUP (coalesce(network, 'Unassigned'), label)")
def agg2_overlap_hierarchy(spark, sf):
    return overlap.hierarchy(overlap.parcel_overlap(S.mask(spark, sf), S.atlas(spark)), S.names(spark, sf))


@query(f"WITH {MASK} SELECT network AS name, count(*) AS voxels FROM atlas JOIN names USING (label) GROUP BY 1")
def agg3_label_sizes(spark, sf):
    return overlap.label_sizes(S.atlas(spark), S.names(spark, sf), "network")


@query(f"WITH {OVERLAP} SELECT label, coalesce(parcel, 'Parcel ' || label) AS parcel, coalesce(network, 'Unassigned') AS network, voxels FROM parcels LEFT JOIN names USING (label) ORDER BY voxels DESC, label")
def jn3_named_parcels(spark, sf):
    out = overlap.name_parcels(overlap.parcel_overlap(S.mask(spark, sf), S.atlas(spark)), S.names(spark, sf))
    return overlap.order_parcels(out).select("label", "parcel", "network", "voxels")


@query(f"WITH {OVERLAP}, ns AS (SELECT network, count(*) AS network_size FROM atlas JOIN names USING (label) GROUP BY 1) SELECT network, voxels, {M('fraction')} AS fraction, network_size, {M('voxels / network_size')} AS of_network FROM summary LEFT JOIN ns USING (network) WHERE voxels >= (SELECT sum(voxels) / 6 FROM hits)")
def rpt2_direct_overlap(spark, sf):
    mask = S.mask(spark, sf)
    out = overlap.direct_overlap(mask, S.atlas(spark), S.names(spark, sf), mask.count() / 6)
    return out.select("network", "voxels", micro(F.col("fraction")).alias("fraction"), "network_size", micro(F.col("fraction_of_network")).alias("of_network"))


@query(f"""WITH {OVERLAP}, ns AS (SELECT network, count(*) AS network_size FROM atlas JOIN names USING (label) GROUP BY 1)
SELECT 'network,voxels,fraction,network_size,fraction_of_network,parcels' AS line UNION ALL
SELECT concat_ws(',', network, voxels, printf('%.4f', fraction), coalesce(CAST(network_size AS VARCHAR), ''), coalesce(printf('%.4f', voxels / network_size), ''), array_to_string(parcels, ';')) FROM summary LEFT JOIN ns USING (network)""")
def snk4_overlap_csv(spark, sf):
    return overlap.overlap_csv(overlap.direct_overlap(S.mask(spark, sf), S.atlas(spark), S.names(spark, sf)))


# Channel packs

_WEIGHTS = f"WITH {OVERLAP}, {PACK}, w AS (SELECT channel, coalesce(fraction, 0) AS w FROM channels LEFT JOIN (SELECT * FROM summary WHERE network <> 'Unassigned') USING (network)), total_map AS (SELECT vid, sum(w * t) AS value FROM pack JOIN w USING (channel) WHERE w <> 0 GROUP BY 1)"


def _weights(spark, sf):
    summary = overlap.network_rollup(overlap.parcel_overlap(S.mask(spark, sf), S.atlas(spark)), S.names(spark, sf))
    return connect.network_weights(S.channel_networks(spark, sf), summary)


def _network_map(spark, sf):
    return connect.weighted_sum(S.pack(spark, sf), _weights(spark, sf)).withColumn("volume_id", F.lit("map"))


@query(f"{_WEIGHTS} SELECT channel, {M('w')} AS w FROM w")
def jn4_network_weights(spark, sf):
    return _weights(spark, sf).select("channel", micro(F.col("w")).alias("w"))


@query(f"WITH {OVERLAP} SELECT CAST(range AS VARCHAR) AS label, {M('coalesce(fl, 0)')} AS w FROM range(1, 26) LEFT JOIN parcels ON label = range")
def jn5_parcel_weights(spark, sf):
    labels = spark.range(1, 26).select(F.col("id").alias("label"))
    return connect.parcel_weights(labels, overlap.parcel_overlap(S.mask(spark, sf), S.atlas(spark))).select("label", micro(F.col("w")).alias("w"))


@query(f"{_WEIGHTS} SELECT vid, {M('value')} AS value FROM total_map")
def agg4_weighted_sum(spark, sf):
    return _network_map(spark, sf).select(F.col("vid").cast("long").alias("vid"), micro(F.col("value")).alias("value"))


@query("SELECT DISTINCT l_partkey AS shard FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice >= 0.97 * (SELECT max(o_totalprice) FROM orders)")
def jn7_requested_shards(spark, sf):
    """Parts are shards, their orders channels; the dearest orders are asked for."""
    shards = S.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("shard")).agg(F.collect_set(F.col("l_orderkey").cast("string")).alias("channel_labels"))
    orders = S.table(spark, sf, "orders")
    top = F.broadcast(orders.agg(F.max("o_totalprice").alias("top")))  # one row
    asked = orders.crossJoin(top).where(F.col("o_totalprice") >= 0.97 * F.col("top"))
    return connect.requested_shards(shards, asked.select(F.col("o_orderkey").cast("string").alias("channel_label")))


@query(f"{_WEIGHTS} SELECT {M('quantile_cont(abs(value), 0.9)')} AS cutoff FROM total_map")
def agg5_abs_quantile(spark, sf):
    return stats.abs_quantile(_network_map(spark, sf), 0.9).select(micro(F.col("cutoff")).alias("cutoff"))


@query(f"{_WEIGHTS} SELECT vid FROM total_map WHERE value > (SELECT quantile_cont(abs(value), 0.9) FROM total_map)")
def prj2_percentile_mask(spark, sf):
    return stats.percentile_mask(_network_map(spark, sf), 0.9).select(F.col("vid").cast("long").alias("vid"))


@query(f"{_WEIGHTS} SELECT vid FROM total_map WHERE abs(value) > (SELECT quantile_cont(abs(value), 0.9) FROM total_map)")
def prj2_symmetric_mask(spark, sf):
    return stats.percentile_mask(_network_map(spark, sf), 0.9, True).select(F.col("vid").cast("long").alias("vid"))


@query(f"WITH {VOL}, d AS (SELECT value - (SELECT avg(value) FROM vol) AS v FROM vol) SELECT {M('min(v)')} AS low, {M('max(v)')} AS high, count(*) FILTER (WHERE abs(v) > 5) AS strong FROM d")
def agg18_map_stats(spark, sf):
    """A map of deviations from the mean; 5 is the operator's own cutoff."""
    v = elementwise.with_stats(written(S.volume(spark, sf)), mean=F.avg("value")).withColumn("value", F.col("value") - F.col("mean"))
    out = connect.map_stats(v)
    return out.select(micro(F.col("low")).alias("low"), micro(F.col("high")).alias("high"), "strong")


_FLAGSHIP = f"{_WEIGHTS}, beyond AS (SELECT vid FROM total_map WHERE value > (SELECT quantile_cont(abs(value), 0.75) FROM total_map)), hit AS (SELECT label, count(*) AS voxels FROM beyond JOIN atlas USING (vid) GROUP BY 1) SELECT coalesce(network, 'Unassigned') AS network, CAST(sum(voxels) AS BIGINT) AS voxels FROM hit LEFT JOIN names USING (label) GROUP BY 1"


@query(_FLAGSHIP)
def flagship_network_report(spark, sf):
    """Overlap, weights, weighted map, threshold, and the overlap of what is beyond it."""
    beyond = stats.percentile_mask(_network_map(spark, sf), 0.75)
    out = overlap.network_rollup(overlap.parcel_overlap(beyond, S.atlas(spark)), S.names(spark, sf))
    return out.select("network", "voxels")


# Element-wise


@query(f"WITH {VOL} SELECT vid FROM vol WHERE value > 0.5 * (SELECT max(value) FROM vol)")
def prj6_foreground(spark, sf):
    return elementwise.foreground(S.volume(spark, sf), 0.5).select("vid")


@query(f"WITH {VOL}, v AS (SELECT *, CASE WHEN z % 2 = 0 THEN 'even' ELSE 'odd' END AS volume_id FROM vol) SELECT volume_id, vid FROM v WHERE volume_id = 'even' AND value > 0.5 * (SELECT max(value) FROM v WHERE volume_id = 'even') UNION ALL SELECT 'odd', 8 + 16 * (8 + 16 * 8)")
def prj7_foreground_fallback(spark, sf):
    """Even slices have a foreground; odd ones, put to zero, have none and get the centre."""
    odd = F.col("z") % 2 == 1
    v = S.volume(spark, sf).drop("n").withColumns({"volume_id": F.when(odd, "odd").otherwise("even"), "value": F.when(odd, 0.0).otherwise(F.col("value"))})
    return elementwise.foreground_or_centre(v, DIMS, 0.5).select("volume_id", "vid")


@query(f"WITH {VOL} SELECT vid, {M('(value - (SELECT avg(value) FROM vol)) / (SELECT stddev_pop(value) FROM vol)')} AS z FROM vol")
def prj8_z_score(spark, sf):
    return elementwise.z_score(S.volume(spark, sf)).select("vid", micro(F.col("value")).alias("z"))


_SPARSE = f"WITH {VOL}, sv AS (SELECT vid, CASE vid % 11 WHEN 3 THEN CAST('NaN' AS DOUBLE) WHEN 7 THEN CAST('Infinity' AS DOUBLE) ELSE CASE WHEN n > (SELECT avg(n) FROM vol) THEN value ELSE 0 END END AS v FROM vol), ok AS (SELECT v FROM sv WHERE isfinite(v) AND v <> 0)"


@query(f"{_SPARSE} SELECT vid, {M('CASE WHEN isfinite(v) THEN (v - (SELECT avg(v) FROM ok)) / (SELECT stddev_pop(v) FROM ok) ELSE 0 END')} AS z FROM sv")
def prj9_z_score_nonzero(spark, sf):
    """Values of NaN and infinity among the others: they don't count and become 0."""
    odd = F.when(F.col("vid") % 11 == 3, float("nan")).when(F.col("vid") % 11 == 7, float("inf")).when(F.col("n") > F.col("mean"), F.col("value")).otherwise(0.0)
    v = elementwise.with_stats(written(S.volume(spark, sf)), mean=F.avg("n")).withColumn("value", odd)
    return elementwise.z_score_nonzero(v).select("vid", micro(F.col("value")).alias("z"))


@query(f"WITH {VOL}, low AS (SELECT vid, value - (SELECT min(value) FROM vol) AS v FROM vol), nz AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM low WHERE v > 0), top AS (SELECT v AS t FROM nz WHERE r = floor(n * 0.99)) SELECT vid, {M('least(1.0, greatest(0.0, v / t))')} AS value FROM low, top")
def prj10_p99_normalise(spark, sf):
    return elementwise.p99_normalise(S.volume(spark, sf)).select("vid", micro(F.col("value")).alias("value"))


@query(f"WITH {VOL}, r AS (SELECT value, row_number() OVER (ORDER BY vid) - 1 AS i, count(*) OVER () AS n FROM vol), p AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS m FROM r WHERE i % greatest(1, CAST(floor(n / 1000) AS BIGINT)) = 0), e AS (SELECT max(value) FILTER (WHERE k = floor((m - 1) * 0.01)) AS lo, max(value) FILTER (WHERE k = floor((m - 1) * 0.99)) AS hi FROM p) SELECT vid, {M('least(1.0, greatest(0.0, (value - lo) / (hi - lo)))')} AS value FROM vol, e")
def prj11_robust_normalise(spark, sf):
    return elementwise.robust_normalise(S.volume(spark, sf), sample=1000).select("vid", micro(F.col("value")).alias("value"))


@query(f"WITH {VOL} SELECT vid, {M('(value - (SELECT min(value) FROM vol)) / ((SELECT max(value) FROM vol) - (SELECT min(value) FROM vol))')} AS value FROM vol")
def prj12_min_max(spark, sf):
    return elementwise.min_max(S.volume(spark, sf)).select("vid", micro(F.col("value")).alias("value"))


@query(f"WITH {VOL} SELECT vid, {M('1 / (1 + exp(-(value - 300) / 100))')} AS p, {M('exp(value / 100 - greatest(value, n * 20) / 100) / (exp(value / 100 - greatest(value, n * 20) / 100) + exp(n / 5.0::DOUBLE - greatest(value, n * 20) / 100))')} AS s, {M('sqrt(x * x + y * y + z * z)')} AS m, {M('value - n')} AS c FROM vol")
def prj13_elementwise_functions(spark, sf):
    v = S.volume(spark, sf)
    return v.select(
        "vid",
        micro(elementwise.sigmoid((F.col("value") - 300) / 100)).alias("p"),
        micro(elementwise.softmax(F.array(F.col("value") / 100, F.col("n") / 5), 0)).alias("s"),
        micro(elementwise.magnitude(F.col("x"), F.col("y"), F.col("z"))).alias("m"),
        micro(elementwise.collapse_logits(F.col("value"), F.col("n"))).alias("c"),
    )


@query(f"WITH {VOL} SELECT vid, CASE WHEN (x // 4 + y // 4 + z // 4) % 2 = 0 THEN value ELSE CAST(n AS DOUBLE) END AS value FROM vol")
def prj17_checkerboard(spark, sf):
    v = S.volume(spark, sf)
    return elementwise.checkerboard(v, v.withColumn("value", F.col("n").cast("double")), 4).select("vid", "value")


@query(f"WITH {VOL} SELECT vid, greatest(CAST(floor((value - 300) / 10 + 0.5) AS BIGINT), 0) AS label FROM vol WHERE value >= 100 AND value < 500")
def prj18_clean_labels(spark, sf):
    v = elementwise.below(elementwise.above(S.volume(spark, sf), 99.5), 500)
    return v.select("vid", elementwise.clean_label((F.col("value") - 300) / 10).alias("label"))


@query(f"WITH {VOL}, f AS (SELECT CASE WHEN n % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN n % 7 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE value - 300 END AS v FROM vol) SELECT min(v) AS low, max(v) AS high, max(abs(v)) AS top FROM f WHERE isfinite(v)")
def prj25_finite_range(spark, sf):
    odd = F.when(F.col("n") % 7 == 0, float("nan")).when(F.col("n") % 7 == 1, float("inf")).otherwise(F.col("value") - 300)
    return elementwise.finite_range(S.volume(spark, sf).withColumn("value", odd)).drop("volume_id")


@query("""WITH h AS (SELECT n_nationkey AS label, n_name, (n_nationkey * 137.508::DOUBLE) % 360 / 60 AS h FROM nation), c AS (SELECT *, CAST(floor(h) AS INT) AS s, 0.95::DOUBLE * 0.65 AS c, 0.95::DOUBLE * 0.65 * (1 - abs(h % 2 - 1)) AS x FROM h)
SELECT label, CAST(floor((CASE WHEN s IN (0, 5) THEN c WHEN s IN (1, 4) THEN x ELSE 0 END + 0.95 - c) * 255 + 0.5) AS INT) AS r, CAST(floor((CASE WHEN s IN (1, 2) THEN c WHEN s IN (0, 3) THEN x ELSE 0 END + 0.95 - c) * 255 + 0.5) AS INT) AS g,
CAST(floor((CASE WHEN s IN (3, 4) THEN c WHEN s IN (2, 5) THEN x ELSE 0 END + 0.95 - c) * 255 + 0.5) AS INT) AS b, 'LH_' || n_name AS name FROM c""")
def prj23_colours_and_names(spark, sf):
    n = S.table(spark, sf, "nation")
    name = elementwise.clean_parcel_name(F.concat(F.lit("7Networks_LH_"), "n_name"))
    out = n.select(F.col("n_nationkey").alias("label"), elementwise.parcel_colour(F.col("n_nationkey")).alias("c"), name.alias("name"))
    return out.select("label", "c.r", "c.g", "c.b", "name")


# Statistics


@query(f"WITH {VOL}, e AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM vol), h AS (SELECT CAST(floor((value - lo) * 4095 / (hi - lo) + 0.5) AS BIGINT) AS bin, count(*) AS c FROM vol, e GROUP BY 1), u AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS upto FROM h) SELECT min(bin) FILTER (WHERE upto >= floor(n * 0.02)) AS low_bin, min(bin) FILTER (WHERE upto >= floor(n * 0.998)) AS high_bin FROM u, e")
def agg6_percentile_window(spark, sf):
    return stats.percentile_window(S.volume(spark, sf)).select("low_bin", "high_bin")


@query(f"WITH {MASK} SELECT count(*) AS n, {M('avg(x)')} AS cx, {M('avg(y)')} AS cy, {M('avg(z)')} AS cz, {M('covar_pop(x, x)')} AS cxx, {M('covar_pop(x, y)')} AS cxy, {M('covar_pop(z, z)')} AS czz FROM mask")
def agg7_moments(spark, sf):
    m = stats.moments(S.mask(spark, sf))
    return m.select("n", *(micro(F.col(c)).alias(c) for c in ("cx", "cy", "cz", "cxx", "cxy", "czz")))


@query(f"WITH {VOL}, s AS (SELECT * FROM vol WHERE value > 0.8 * (SELECT max(value) FROM vol)) SELECT count(*) = 0 AS empty, greatest(0, min(x) - 1) AS x0, least(16, max(x) + 2) AS x1, greatest(0, min(y) - 1) AS y0, least(16, max(y) + 2) AS y1, greatest(0, min(z) - 1) AS z0, least(16, max(z) + 2) AS z1 FROM s")
def agg9_bounding_box(spark, sf):
    v = elementwise.with_stats(written(S.volume(spark, sf)), top=F.max("value")).withColumn("value", F.when(F.col("value") > 0.8 * F.col("top"), F.col("value")).otherwise(0.0))
    return stats.bounding_box(v, DIMS, 1).select("empty", "x0", "x1", "y0", "y1", "z0", "z1")


@query(f"WITH {VOL} SELECT z, min(value) AS low, max(value) AS high, {M('avg(value)')} AS mean, count(*) FILTER (WHERE value >= 400) AS \"over\" FROM vol GROUP BY 1")
def agg19_value_stats(spark, sf):
    return stats.value_stats(S.volume(spark, sf), 400, ["z"]).withColumn("mean", micro(F.col("mean")))


# Geometry

_GRID8 = "grid8 AS (SELECT CAST(range % 8 AS INT) AS x, CAST(range // 8 % 8 AS INT) AS y, CAST(range // 64 AS INT) AS z FROM range(512))"
_TWO = ((2.0, 0, 0, 0), (0, 2.0, 0, 0), (0, 0, 2.0, 0), (0, 0, 0, 1.0))
_HALF = ((2.0, 0, 0, 0.5), (0, 2.0, 0, 0.5), (0, 0, 2.0, 0.5), (0, 0, 0, 1.0))


@query(f"WITH {VOL}, {_GRID8} SELECT g.x, g.y, g.z, coalesce(v.value, 0) AS value FROM grid8 g LEFT JOIN vol v ON v.x = 2 * g.x AND v.y = 2 * g.y AND v.z = 2 * g.z")
def geo1_resample_nearest(spark, sf):
    from ..model import IDENTITY

    return geometry.resample_nearest(S.volume(spark, sf), IDENTITY, (8, 8, 8), _TWO).select("x", "y", "z", "value")


@query(f"WITH {VOL}, {_GRID8} SELECT g.x, g.y, g.z, {M('coalesce(sum(v.value), 0) / 8')} AS value FROM grid8 g LEFT JOIN vol v ON v.x // 2 = g.x AND v.y // 2 = g.y AND v.z // 2 = g.z GROUP BY 1, 2, 3")
def geo2_resample_linear(spark, sf):
    from ..model import IDENTITY

    out = geometry.resample_linear(S.volume(spark, sf), IDENTITY, (8, 8, 8), _HALF)
    return out.select("x", "y", "z", micro(F.col("value")).alias("value"))


@query(f"WITH {VOL}, c AS (SELECT CAST(range % 11 AS INT) AS x, CAST(range // 11 % 11 AS INT) AS y, CAST(range // 121 AS INT) AS z FROM range(1331)), w AS (SELECT c.*, x * 1.5::DOUBLE AS sx, y * 1.5::DOUBLE AS sy, z * 1.5::DOUBLE AS sz FROM c) SELECT w.x, w.y, w.z, {M('coalesce(sum((1 - abs(sx - v.x)) * (1 - abs(sy - v.y)) * (1 - abs(sz - v.z)) * v.value), 0)')} AS value FROM w LEFT JOIN vol v ON abs(sx - v.x) < 1 AND abs(sy - v.y) < 1 AND abs(sz - v.z) < 1 GROUP BY 1, 2, 3")
def geo3_resize_linear(spark, sf):
    out = geometry.resize_linear(S.volume(spark, sf), DIMS, (11, 11, 11))
    return out.select("x", "y", "z", micro(F.col("value")).alias("value"))


_LABELS = VOL + ", atlas AS (SELECT vid, x, y, z, CAST(n % 26 AS INT) AS label FROM vol WHERE n % 26 <> 0)"


def _labels(spark, sf):
    """A label volume of the tables: counts of line items modulo 26, 0 left out."""
    return S.volume(spark, sf).select("volume_id", "vid", "x", "y", "z", (F.col("n") % 26).cast("int").alias("value")).where("value <> 0")


@query(f"WITH {_LABELS}, {_GRID8} SELECT g.x, g.y, g.z, coalesce(label, 0) AS label FROM grid8 g LEFT JOIN atlas ON vid = (2 * g.x + 1) + 16 * (2 * g.y + 1) + 256 * (2 * g.z + 1)")
def geo4_resize_labels(spark, sf):
    labels = _labels(spark, sf)
    return geometry.resize_labels(labels, DIMS, (8, 8, 8)).select("x", "y", "z", F.col("value").cast("int").alias("label"))


@query(f"WITH {MASK} SELECT x - 3 AS x, y - 2 AS y, z - 4 AS z FROM mask WHERE x BETWEEN 3 AND 11 AND y BETWEEN 2 AND 12 AND z BETWEEN 4 AND 9")
def geo6_crop(spark, sf):
    return _ones(geometry.crop(S.mask(spark, sf), (3, 2, 4), (12, 13, 10)))


@query(f"WITH {VOL}, g AS (SELECT CAST(range AS INT) AS vid FROM range(4096)) SELECT g.vid, coalesce(CASE WHEN x BETWEEN 3 AND 11 AND y BETWEEN 2 AND 12 AND z BETWEEN 4 AND 9 THEN value END, -1.0::DOUBLE) AS value FROM g LEFT JOIN vol USING (vid)")
def geo7_place_back(spark, sf):
    box = geometry.crop(S.volume(spark, sf), (3, 2, 4), (12, 13, 10))
    out = geometry.place_back(box, (3, 2, 4), DIMS, -1.0)
    return out.select(geometry.linear_id(DIMS).cast("int").alias("vid"), "value")


@query(f"WITH {MASK} SELECT x + 24 AS x, y + 24 AS y, z + 24 AS z FROM mask")
def geo8_centre_pad(spark, sf):
    return _ones(geometry.centre_pad(S.mask(spark, sf), DIMS, (64, 64, 64)))


@query(f"WITH {MASK} SELECT 15 - x AS x, 15 - z AS y, y AS z FROM mask")
def geo10_orient(spark, sf):
    return _ones(geometry.orient(S.mask(spark, sf), DIMS, (0, 2, 1), (True, True, False)))


@query(f"WITH {MASK} SELECT (x * 16 + y) * 16 + z AS row_major, vid FROM mask")
def geo13_voxel_order(spark, sf):
    return S.mask(spark, sf).select(geometry.row_major_id(DIMS).alias("row_major"), "vid")


@query(f"WITH {MASK} SELECT x, y, z - 5 AS z FROM mask WHERE z BETWEEN 5 AND 15")
def geo14_slice_range(spark, sf):
    return _ones(geometry.slice_range(S.mask(spark, sf), 5, 40, 16))


@query(f"WITH {VOL}, s AS (SELECT unnest([0, 5, 9]) AS p), q AS (SELECT row_number() OVER (ORDER BY c.p, b.p, a.p) - 1 AS patch, a.p AS px, b.p AS py, c.p AS pz FROM s a, s b, s c) SELECT patch, px, py, pz, value AS corner FROM q LEFT JOIN vol ON x = px AND y = py AND z = pz")
def geo15_patch_positions(spark, sf):
    """Patch starts and what the volume holds there."""
    first = S.volume(spark, sf).select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("value").alias("corner"))
    return geometry.patch_positions(spark, DIMS, (7, 7, 7), 0.25).join(first, ["px", "py", "pz"], "left").select("patch", "px", "py", "pz", "corner")


@query(f"WITH {VOL}, s AS (SELECT unnest([0, 5, 9]) AS p) SELECT a.p AS px, b.p AS py, c.p AS pz, count(*) AS voxels, sum(value) AS total FROM vol, s a, s b, s c WHERE x >= a.p AND x < a.p + 7 AND y >= b.p AND y < b.p + 7 AND z >= c.p AND z < c.p + 7 GROUP BY 1, 2, 3")
def geo16_patch_voxels(spark, sf):
    out = geometry.patch_voxels(S.volume(spark, sf), DIMS, (7, 7, 7), 0.25)
    return out.groupBy("px", "py", "pz").agg(F.count(F.lit(1)).alias("voxels"), F.sum("value").alias("total"))


@query(f"WITH {MASK}, {_GRID8} SELECT g.x, g.y, g.z FROM grid8 g JOIN mask v ON v.x = 2 * g.x AND v.y = 2 * g.y AND v.z = 2 * g.z")
def geo19_resample_mask(spark, sf):
    from ..model import IDENTITY

    return _ones(geometry.resample_mask(S.mask(spark, sf), IDENTITY, (8, 8, 8), _TWO))


@query(f"WITH {_LABELS}, {_GRID8} SELECT g.x, g.y, g.z, CAST(label AS BIGINT) AS label FROM grid8 g JOIN atlas ON vid = 2 * g.x + 32 * g.y + 512 * g.z")
def geo21_project_atlas(spark, sf):
    from ..model import IDENTITY

    return geometry.project_atlas(_labels(spark, sf), IDENTITY, (8, 8, 8), _TWO).select("x", "y", "z", F.col("value").cast("long").alias("label"))


# Components and morphology

_REACH = """near AS (SELECT a.vid AS a, b.vid AS b FROM mask a JOIN mask b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
reach AS (SELECT vid AS root, vid FROM mask UNION SELECT root, b FROM reach JOIN near ON a = vid),
comp AS (SELECT vid, min(root) AS component FROM reach GROUP BY 1), sized AS (SELECT component, count(*) AS voxels FROM comp GROUP BY 1)"""
_COMPONENTS = f"WITH RECURSIVE {MASK},\n{_REACH}"


@query(f"{_COMPONENTS} SELECT vid, component FROM comp")
def mor1_components(spark, sf):
    return morphology.label_components(S.mask(spark, sf), DIMS).select("vid", F.col("component").cast("int").alias("component"))


@query(f"{_COMPONENTS} SELECT vid FROM comp JOIN sized USING (component) WHERE voxels >= 5")
def mor2_remove_small(spark, sf):
    return morphology.remove_small(S.mask(spark, sf), DIMS, 5).select("vid")


@query(f"{_COMPONENTS}, s AS (SELECT list_reverse_sort(list(voxels)) AS l FROM sized) SELECT CAST(len(l) AS INT) AS components, l[1] AS largest, array_to_string(l[1:5], ',') AS largest_five FROM s")
def agg12_component_summary(spark, sf):
    return morphology.component_summary(morphology.label_components(S.mask(spark, sf), DIMS)).drop("volume_id")


_LARGEST_FILLED = """, best AS (SELECT component FROM sized ORDER BY voxels DESC, component LIMIT 1), big AS (SELECT vid FROM comp JOIN best USING (component)),
free AS (SELECT CAST(range AS INT) AS vid, CAST(range % 16 AS INT) AS x, CAST(range // 16 % 16 AS INT) AS y, CAST(range // 256 AS INT) AS z FROM range(4096) WHERE range NOT IN (SELECT vid FROM big)),
outside AS (SELECT vid, x, y, z FROM free WHERE least(x, y, z) = 0 OR greatest(x, y, z) = 15 UNION SELECT f.vid, f.x, f.y, f.z FROM outside o JOIN free f ON abs(f.x - o.x) <= 1 AND abs(f.y - o.y) <= 1 AND abs(f.z - o.z) <= 1)
SELECT CAST(range % 16 AS INT) AS x, CAST(range // 16 % 16 AS INT) AS y, CAST(range // 256 AS INT) AS z FROM range(4096)
WHERE range IN (SELECT vid FROM big) OR (range NOT IN (SELECT vid FROM outside) AND (SELECT count(*) FROM sized) > 1)"""


@query(_COMPONENTS + _LARGEST_FILLED)
def mor3_keep_largest_and_fill(spark, sf):
    return _ones(morphology.keep_largest_and_fill(S.mask(spark, sf), DIMS))


@query(f"WITH {MASK}, o AS (SELECT * FROM (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dx, dy, dz)), d1 AS (SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM mask, o), d2 AS (SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM d1, o WHERE least(x, y, z) >= 0 AND greatest(x, y, z) < 16) SELECT * FROM d2 WHERE least(x, y, z) >= 0 AND greatest(x, y, z) < 16")
def mor4_dilate(spark, sf):
    return _ones(morphology.dilate(S.mask(spark, sf), DIMS, 2, side=8))


@query(f"WITH {VOL}, m AS (SELECT x, y, z FROM vol WHERE value >= (SELECT avg(value) FROM vol)), g AS (SELECT CAST(range % 16 AS INT) AS x, CAST(range // 16 % 16 AS INT) AS y, CAST(range // 256 AS INT) AS z FROM range(4096)) SELECT g.x, g.y, g.z FROM g JOIN m ON abs(g.x - m.x) <= 1 AND abs(g.y - m.y) <= 1 AND abs(g.z - m.z) <= 1 GROUP BY 1, 2, 3 HAVING count(*) >= 14")
def mor6_smooth(spark, sf):
    v = elementwise.with_stats(written(S.volume(spark, sf)), mean=F.avg("value")).where(F.col("value") >= F.col("mean"))
    return _ones(morphology.smooth(v, DIMS, side=8))


@query(f"WITH {MASK}, g AS (SELECT CAST(range % 16 AS INT) AS x, CAST(range // 16 % 16 AS INT) AS y, CAST(range // 256 AS INT) AS z FROM range(4096)) SELECT x, y, z FROM g ANTI JOIN mask USING (x, y, z)")
def set7_complement(spark, sf):
    return _ones(morphology.complement(S.mask(spark, sf), DIMS))


_CLEAN = _COMPONENTS.replace(MASK, VOL + ", mask AS (SELECT vid, x, y, z FROM vol WHERE value > (SELECT quantile_cont(abs(value), 0.8) FROM vol))")


@query(f"{_CLEAN} SELECT (SELECT count(*) FROM mask) AS raw_count, CAST(sum(voxels) AS BIGINT) AS kept_count, (SELECT count(*) FROM mask) - CAST(sum(voxels) AS BIGINT) AS removed_by_cluster FROM sized WHERE voxels >= 5")
def mor5_threshold_and_clean(spark, sf):
    return morphology.threshold_and_clean(S.volume(spark, sf), DIMS, 0.8, least=5)[1]


# Ranking


_RANK = f"""WITH w AS (SELECT p_type AS network, count(*) / (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey) AS fraction FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
p AS (SELECT p_type AS network, p_brand AS term, avg(p_retailprice) / 2000 AS score FROM part GROUP BY 1, 2),
c AS (SELECT term, network, fraction * score AS part FROM p JOIN w USING (network)), t AS (SELECT term, sum(part) AS score FROM c GROUP BY 1 HAVING sum(part) >= 0.01 ORDER BY 2 DESC, 1 LIMIT 8)"""


@query(f"{_RANK} SELECT term, {M('t.score')} AS score, (SELECT string_agg(network, ';' ORDER BY part DESC, network) FROM (SELECT network, part FROM c WHERE c.term = t.term ORDER BY part DESC, network LIMIT 3)) AS contributors FROM t")
def rpt1_rank_terms(spark, sf):
    out = rank.rank_terms(S.type_shares(spark, sf), S.profile(spark, sf))
    return out.select("term", micro(F.col("score")).alias("score"), F.array_join("contributors", ";").alias("contributors"))


@query("WITH a AS (SELECT l_suppkey % 50 AS study, l_returnflag AS parcel, avg(l_quantity) AS a FROM lineitem GROUP BY 1, 2), w AS (SELECT l_suppkey % 50 AS study, l_linestatus AS term, avg(l_discount) AS weight FROM lineitem GROUP BY 1, 2), r AS (SELECT parcel, term, covar_pop(a, weight) / (stddev_pop(a) * stddev_pop(weight)) AS r FROM a JOIN w USING (study) GROUP BY 1, 2) SELECT parcel, term, CAST(floor(r * 1000000 + 0.5) AS BIGINT) AS r, CAST(row_number() OVER (PARTITION BY parcel ORDER BY r.r DESC, term) AS INT) AS rank FROM r WHERE r.r > -1")
def rpt8_parcel_profiles(spark, sf):
    li = S.table(spark, sf, "lineitem").withColumn("study", F.col("l_suppkey") % 50)
    activation = li.select("study", F.col("l_returnflag").alias("parcel"), F.col("l_quantity").alias("value"))
    weights = li.groupBy("study", F.col("l_linestatus").alias("term")).agg(F.avg("l_discount").alias("weight"))
    out = rank.parcel_profiles(rank.roi_association(activation, weights), least=-1.0)
    return out.withColumn("r", micro(F.col("r")))


# Evaluation

_COUNTS = f"WITH {CASES}, k AS (SELECT lang, source, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 1 AND quality <> 1) AS fp, count(*) FILTER (WHERE toxic <> 1 AND quality = 1) AS fn FROM d WHERE toxic = 1 OR quality = 1 GROUP BY 1, 2)"


@query(f"{_COUNTS} SELECT lang, source, tp, fp, fn, {M('2 * tp / (2 * tp + fp + fn)')} AS dice, {M('tp / (tp + fp + fn)')} AS jaccard, {M('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END')} AS \"precision\", {M('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END')} AS recall FROM k")
def agg13_segmentation_scores(spark, sf):
    out = evaluate.scores(evaluate.confusion(*S.predictions(spark, sf), ["lang", "source"]))
    return out.select("lang", "source", "tp", "fp", "fn", *(micro(F.col(c)).alias(c) for c in ("dice", "jaccard", "precision", "recall")))


@query(f"WITH {CASES} SELECT lang, vid, CASE WHEN toxic = 1 AND quality = 1 THEN 1 WHEN toxic = 1 THEN 2 ELSE 3 END AS kind FROM d WHERE toxic = 1 OR quality = 1")
def snk7_difference_map(spark, sf):
    return evaluate.difference_map(*S.predictions(spark, sf), ["lang"])


@query(f"{_COUNTS} SELECT lang, count(*) AS cases, {M('avg(2 * tp / (2 * tp + fp + fn))')} AS mean_dice FROM k GROUP BY 1 ORDER BY 1")
def agg17_report(spark, sf):
    m = evaluate.scores(evaluate.confusion(*S.predictions(spark, sf), ["lang", "source"]))
    return evaluate.report(m, ["lang"], ["dice"]).withColumn("mean_dice", micro(F.col("mean_dice")))


def _sweep(spark, sf):
    d = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id").withColumn("vid", F.col("doc_id"))
    p = d.select("lang", "vid", F.col("n_chars").cast("double").alias("p"))
    return evaluate.threshold_sweep(p, d.where("quality = 1").select("lang", "vid"), [500.0, 1000.0, 2000.0], ["lang"])


_SWEEP = "WITH d AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)), s AS (SELECT lang, CAST(thr AS DOUBLE) AS threshold, count(*) FILTER (WHERE n_chars >= thr AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars >= thr AND quality <> 1) AS fp, count(*) FILTER (WHERE n_chars < thr AND quality = 1) AS fn FROM d, (SELECT unnest([500, 1000, 2000]) AS thr) GROUP BY 1, 2)"


@query(f"{_SWEEP} SELECT lang, threshold, tp, fp, fn, {M('2 * tp / (2 * tp + fp + fn)')} AS dice FROM s")
def rpt4_threshold_sweep(spark, sf):
    return _sweep(spark, sf).select("lang", "threshold", "tp", "fp", "fn", micro(F.col("dice")).alias("dice"))


@query(f"{_SWEEP} SELECT lang, threshold, {M('2 * tp / (2 * tp + fp + fn)')} AS mean_dice FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, threshold) = 1")
def win4_best_threshold(spark, sf):
    return evaluate.best_threshold(_sweep(spark, sf), ["lang"]).withColumn("mean_dice", micro(F.col("mean_dice")))


@query(f"{_COUNTS}, m AS (SELECT lang, source, 2 * tp / (2 * tp + fp + fn) AS dice FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY dice DESC, source) AS b, row_number() OVER (PARTITION BY lang ORDER BY dice, source) AS w FROM m) SELECT lang, source, b = 1 AS is_best, w = 1 AS is_worst FROM r WHERE b = 1 OR w = 1")
def snk11_extremes(spark, sf):
    m = evaluate.scores(evaluate.confusion(*S.predictions(spark, sf), ["lang", "source"]))
    return evaluate.extremes(m, ["lang"], "source").select("lang", "source", "is_best", "is_worst")


@query(f"{_COUNTS}, m AS (SELECT lang, source, 2 * tp / (2 * tp + fp + fn) AS dice FROM k) SELECT a.lang, a.source AS mode, {M('a.dice - b.dice')} AS gap, a.dice - b.dice >= -0.01 AS reached FROM m a JOIN m b ON a.lang = b.lang AND b.source = 'src0' WHERE a.source <> 'src0'")
def rpt5_gap_analysis(spark, sf):
    m = evaluate.scores(evaluate.confusion(*S.predictions(spark, sf), ["lang", "source"])).withColumnRenamed("source", "mode")
    return evaluate.gap_analysis(m, ["lang"], "src0").select("lang", "mode", micro(F.col("gap")).alias("gap"), "reached")


def _with_means(spark, sf):
    return elementwise.with_stats(written(S.volume(spark, sf)), mean_value=F.avg("value"), mean_n=F.avg("n"))


@query(f"WITH {MASK} SELECT {M('covar_pop(value, n) / (stddev_pop(value) * stddev_pop(n))')} AS r FROM vol SEMI JOIN mask USING (vid)")
def agg15_masked_correlation(spark, sf):
    v = S.volume(spark, sf).join(S.mask(spark, sf).select("vid"), "vid", "left_semi")
    return evaluate.masked_correlation(v.select("volume_id", F.col("value").alias("a"), F.col("n").alias("b")), ["volume_id"]).select(micro(F.col("r")).alias("r"))


@query(f"WITH {VOL}, a AS (SELECT vid FROM vol WHERE value > (SELECT avg(value) FROM vol)), b AS (SELECT vid FROM vol WHERE n > (SELECT avg(n) FROM vol)), c AS (SELECT vid FROM vol WHERE vid % 3 = 0) SELECT vid FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1 HAVING count(*) >= 2")
def set8_majority(spark, sf):
    v = _with_means(spark, sf)
    return evaluate.majority([v.where("value > mean_value").select("vid"), v.where("n > mean_n").select("vid"), v.where("vid % 3 = 0").select("vid")], 2)


@query(f"WITH {VOL}, m AS (SELECT vid, value > (SELECT avg(value) FROM vol) AS a, n > (SELECT avg(n) FROM vol) AS b FROM vol) SELECT vid, 'union' AS op FROM m WHERE a OR b UNION ALL SELECT vid, 'both' FROM m WHERE a AND b UNION ALL SELECT vid, 'only' FROM m WHERE a AND NOT b")
def set1_mask_sets(spark, sf):
    v = _with_means(spark, sf)
    a, b = v.where("value > mean_value").select("vid"), v.where("n > mean_n").select("vid")
    tag = lambda df, op: df.withColumn("op", F.lit(op))
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "both")).unionByName(tag(a.exceptAll(b), "only"))


@query(f"WITH {VOL}, p AS (SELECT vid, (value / (SELECT max(value) FROM vol) + n / (SELECT max(n) FROM vol)) / 2 AS p FROM vol) SELECT vid, {M('p')} AS p FROM p WHERE p >= 0.5")
def agg29_mean_probability(spark, sf):
    v = elementwise.with_stats(written(S.volume(spark, sf)), top=F.max("value"), most=F.max("n"))
    maps = v.select("volume_id", "vid", (F.col("value") / F.col("top")).alias("p")).unionByName(v.select("volume_id", "vid", (F.col("n") / F.col("most")).alias("p")))
    return evaluate.mean_probability(maps, 0.5).select("vid", micro(F.col("p")).alias("p"))


# Connectivity

_Z = f"WITH {SERIES}, m AS (SELECT subject, region, t, avg(value) AS v FROM s GROUP BY 1, 2, 3), r AS (SELECT a.subject, a.region AS source, b.region AS target, count(*) AS n, covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) * (count(*) - 1) / count(*) AS r FROM m a JOIN m b ON a.subject = b.subject AND a.t = b.t WHERE a.region <> b.region GROUP BY 1, 2, 3), z AS (SELECT source, target, atanh(greatest(least(r, 0.999), -0.999)) AS z FROM r WHERE n > 2)"


@query(f"{_Z} SELECT source, target, count(*) AS n, {M('avg(z)')} AS mean_z, {M('avg(z) / greatest(stddev_samp(z) / sqrt(count(*)), 1e-6)')} AS t FROM z GROUP BY 1, 2")
def rpt7_group_connectome(spark, sf):
    out = connectome.group_connectome(S.series(spark, sf))
    return out.select("source", "target", "n", micro(F.col("mean_z")).alias("mean_z"), micro(F.col("t")).alias("t"))


@query(f"{_Z} SELECT source, target, count(*) AS n, {M('avg(z) / greatest(stddev_pop(z) / sqrt(count(*)), 1e-6)')} AS t FROM z GROUP BY 1, 2")
def agg26_group_t_population(spark, sf):
    out = connectome.group_connectome(S.series(spark, sf), sample=False)
    return out.select("source", "target", "n", micro(F.col("t")).alias("t"))


# Scoring


def _slope_scorer(patch):
    """Half of a voxel, three tenths of its next one along x and two along y; nothing beyond the patch. Flips and the patch's edge both show."""
    out = 0.5 * patch
    out[:-1] += 0.3 * patch[1:]
    out[:, :-1] += 0.2 * patch[:, 1:]
    return out


_WINDOW = f"""WITH {VOL}, s AS (SELECT unnest([0, 6, 8]) AS p), zs AS (SELECT x, y, z, (value - (SELECT avg(value) FROM vol)) / (SELECT stddev_pop(value) FROM vol) AS v FROM vol),
cell AS (SELECT a.p AS px, b.p AS py, c.p AS pz, x, y, z, v FROM zs, s a, s b, s c WHERE x >= a.p AND x < a.p + 8 AND y >= b.p AND y < b.p + 8 AND z >= c.p AND z < c.p + 8),
part AS (SELECT *, 0.5::DOUBLE * v AS q FROM cell UNION ALL SELECT px, py, pz, x - d, y, z, v, 0.3::DOUBLE * v * share FROM cell, (VALUES WAYS) t(d, share) WHERE x - d >= px AND x - d < px + 8
  UNION ALL SELECT px, py, pz, x, y - d, z, v, 0.2::DOUBLE * v * share FROM cell, (VALUES WAYS) t(d, share) WHERE y - d >= py AND y - d < py + 8),
scored AS (SELECT px, py, pz, x, y, z, sum(q) AS q FROM part GROUP BY ALL),
mixed AS (SELECT x + 16 * y + 256 * z AS vid, sum(q * w) / sum(w) AS p FROM (SELECT *, exp(-((x - px - 3.5) ** 2 + (y - py - 3.5) ** 2 + (z - pz - 3.5) ** 2) / 8) AS w FROM scored SEMI JOIN vol USING (x, y, z)) GROUP BY 1)"""


@query(f"{_WINDOW.replace('WAYS', '(1, 0.5::DOUBLE), (-1, 0.5::DOUBLE)')} SELECT vid, {M('p')} AS p FROM mixed")
def inf1_sliding_window(spark, sf):
    """All flips: what the scorer takes from one side it takes from both, half each."""
    probability, _ = score.sliding_window(written(S.volume(spark, sf)), DIMS, (8, 8, 8), _slope_scorer, sigma=2.0, flips=score.FLIPS, side=7)
    return probability.select(geometry.linear_id(DIMS).cast("int").alias("vid"), micro(F.col("p")).alias("p"))


@query(f"{_WINDOW.replace('WAYS', '(1, 1.0::DOUBLE)')} SELECT vid FROM mixed WHERE p >= 0.4")
def inf5_scored_mask(spark, sf):
    """One pass without flips, and its mask."""
    _, mask = score.sliding_window(written(S.volume(spark, sf)), DIMS, (8, 8, 8), _slope_scorer, sigma=2.0)
    return mask.select(geometry.linear_id(DIMS).cast("int").alias("vid"))


_REVERSED = _WINDOW.replace("WAYS", "(1, 1.0::DOUBLE)").replace("px, py, pz, x - d, y, z, v, 0.3", "px, py, pz, x, y, z - d, v, 0.3").replace("x - d >= px AND x - d < px + 8", "z - d >= pz AND z - d < pz + 8")
_KEPT = _REVERSED.replace("WITH ", "WITH RECURSIVE ", 1) + f", mask AS (SELECT vid, vid % 16 AS x, vid // 16 % 16 AS y, vid // 256 AS z FROM mixed WHERE p >= 0.4), {_REACH}"


@query(f"{_KEPT} SELECT CAST(vid % 16 AS INT) AS x, CAST(vid // 16 % 16 AS INT) AS y, CAST(vid // 256 AS INT) AS z FROM comp JOIN sized USING (component) WHERE voxels >= 4")
def inf3_segmentation_step(spark, sf):
    """Axes in reverse order, overlapping patches, a scorer to which patch edges and order show, blending, threshold, and components of fewer than four voxels removed."""
    return steps.segment(written(S.volume(spark, sf)), DIMS, (1.0, 1.0, 1.0), _slope_scorer, (8, 8, 8), zyx=True, sigma=2.0, least=4).select("x", "y", "z")


def _two_logits(block):
    import numpy as np

    return np.stack([block[1], block[0]])


@query(f"WITH {VOL}, z AS (SELECT *, (value - (SELECT avg(value) FROM vol WHERE value <> 0)) / (SELECT stddev_pop(value) FROM vol WHERE value <> 0) AS a, (n - (SELECT avg(n) FROM vol)) / (SELECT stddev_pop(n) FROM vol) AS b FROM vol) SELECT x, y, z FROM z WHERE 1 / (1 + exp(b - a)) >= 0.5")
def inf4_two_channels(spark, sf):
    """Logits are the channels, swapped: where the first channel is larger, the second class wins."""
    v = written(S.volume(spark, sf))
    at = ["volume_id", "x", "y", "z"]
    both = v.select(*at, F.lit(0).alias("channel"), "value").unionByName(v.select(*at, F.lit(1).alias("channel"), F.col("n").cast("double").alias("value")))
    return steps.segment_channels(both, DIMS, (6, 6, 6), _two_logits, 2, least=1, overlap=0.25).select("x", "y", "z")


def _near_middle(block):
    """A distance: two less the normalised value, so that bright voxels lie inside."""
    return 2.0 - 1.5 * block


_BRAIN = _COMPONENTS.replace(MASK, VOL + """, nz AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM vol WHERE value > 0),
top AS (SELECT v AS t FROM nz WHERE r = floor(n * 0.99)), mask AS (SELECT vid, x, y, z FROM vol, top WHERE 2 - 1.5::DOUBLE * least(1, value / t) < 1)""")


@query(_BRAIN + _LARGEST_FILLED)
def inf2_extract_brain(spark, sf):
    """Turned, cropped, padded, normalised by the 99th percentile, thresholded, the largest component filled, and turned back."""
    out = steps.extract_brain(written(S.volume(spark, sf)), DIMS, (1.0, 1.0, 1.0), _near_middle, conform=lambda d: tuple(max(20, n) for n in d))
    return out.select("x", "y", "z")


# Sources and sinks: written, read and compared


@query(f"WITH {VOL}, g AS (SELECT CAST(range AS INT) AS vid FROM range(4096)) SELECT CAST(g.vid AS BIGINT) AS vid, coalesce(value, 0) AS value FROM g LEFT JOIN vol USING (vid)")
def src1_nifti_volume(spark, sf):
    """SRC-1..4, SNK-1, SNK-3: a volume as a compressed file of float32 and back, zeros included."""
    folder = new_folder(spark, "nifti")
    nifti.write_files(nifti.to_files(S.volume(spark, sf), DIMS), folder)
    return nifti.read_voxels(spark, folder).select("vid", "value")


@query(f"WITH {MASK} SELECT CAST(vid AS BIGINT) AS vid, CAST(label AS DOUBLE) AS value, 16 AS nx, 2 AS datatype, 5.0::DOUBLE AS shift FROM atlas")
def snk2_nifti_labels(spark, sf):
    """SNK-2, SRC-3: labels written with the header of a source volume; its affine and grid are kept, its type is not."""
    import numpy as np

    folder, first = new_folder(spark, "nifti"), new_folder(spark, "nifti")
    affine = np.diag([2.0, 3.0, 4.0, 1.0])
    affine[2, 3] = 5
    nifti.write_files(nifti.to_files(S.volume(spark, sf), DIMS, affine), first)
    source = bytes(nifti.read_meta(spark, first).first().header)
    labels = S.atlas(spark).select(F.lit("atlas").alias("volume_id"), "x", "y", "z", F.col("label").alias("value"))
    nifti.write_files(nifti.to_files(labels, DIMS, labels=True, compress=False, source=source), folder, ".nii")
    meta = nifti.read_meta(spark, folder).select("volume_id", "nx", "datatype", F.col("affine")[2][3].alias("shift"))
    return nifti.read_voxels(spark, folder, nonzero=True).join(F.broadcast(meta), "volume_id").select("vid", "value", "nx", "datatype", "shift")


@query(f"WITH {PACK} SELECT channel, vid, {M('t')} AS t FROM pack WHERE channel BETWEEN 4 AND 6")
def src7_pack_shards(spark, sf):
    """SRC-6, SRC-7: a pack in shards of three channels, of which one is read."""
    folder = new_folder(spark, "pack")
    packs.write_pack(S.pack(spark, sf), folder, 3)
    out = packs.read_pack(spark, folder, [4, 5, 6], 3)
    return out.select("channel", "vid", micro(F.col("t")).alias("t"))


@query(f"WITH {VOL} SELECT 1 + z // 8 AS channel, x, y, z % 8 AS z, CAST(n AS BIGINT) AS t FROM vol WHERE n <= 2048")
def src8_packed_half_floats(spark, sf):
    """SRC-8, SRC-9, SNK-8: counts as packed half floats, which hold all whole numbers up to 2048 only (the SQL leaves larger counts out), and back."""
    v = S.volume(spark, sf).where("n <= 2048")
    maps = v.select((1 + F.floor(F.col("z") / 8)).cast("int").alias("channel"), "x", "y", (F.col("z") % 8).alias("z"), F.col("n").alias("t"))
    shards = packs.encode_shards(maps, (16, 16, 8)).select(F.col("channel_labels")[0].cast("int").alias("first_channel"), "content")
    out = packs.decode_pack(shards, packs.index('{"shape": [2, 16, 16, 8], "dtype": "float16"}'))
    return out.where("t <> 0").select("channel", "x", "y", "z", F.col("t").cast("long").alias("t"))


@query("SELECT p_type AS network, p_brand AS term, CAST(floor(avg(p_retailprice) / 2000 * 1000000 + 0.5) AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS INT) AS rank, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_brand) - 1 AS INT) AS ord FROM part GROUP BY 1, 2")
def snk9_profile_json(spark, sf):
    """SNK-9, SRC-10: profiles as one JSON document and back."""
    from pyspark.sql import Window

    p = S.profile(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("network").orderBy("term"))).withColumn("ord", F.col("rank") - 1)
    folder = new_folder(spark, "profile")
    packs.profile_json(p, "types").select("value").coalesce(1).write.text(folder)  # one row
    return packs.read_profiles(spark, folder, "types").select("network", "term", micro(F.col("score")).alias("score"), "rank", "ord")


@query(f"{_COUNTS} SELECT '| lang | cases | mean_dice |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT concat('| ', lang, ' | ', count(*), ' | ', printf('%.4f', avg(2 * tp / (2 * tp + fp + fn))), ' |') FROM k GROUP BY lang")
def snk5_summary(spark, sf):
    """The Markdown summary beside the CSV of all cases, written and read."""
    m = evaluate.scores(evaluate.confusion(*S.predictions(spark, sf), ["lang", "source"]))
    folder = new_folder(spark, "report")
    evaluate.write_report(m.select("lang", "source", "tp", "fp", "fn", "dice"), folder, ["lang"], ["dice"])
    return spark.read.text(f"{folder}/summary").select(F.col("value").alias("line"))


@query(f"{_COUNTS} SELECT lang, CAST(count(*) AS BIGINT) AS cases, {M('avg(2 * tp / (2 * tp + fp + fn)) FILTER (WHERE tp + fn > 1 AND tp > 0)')} AS mean_dice FROM k GROUP BY 1")
def agg16_finite_mean(spark, sf):
    """Cases with one true voxel at most count as NaN, those without a hit as infinite: neither enters the mean."""
    m = evaluate.scores(evaluate.confusion(*S.predictions(spark, sf), ["lang", "source"]))
    odd = F.when(F.col("tp") + F.col("fn") <= 1, float("nan")).when(F.col("tp") == 0, float("inf")).otherwise(F.col("dice"))
    return evaluate.report(m.withColumn("dice", odd), ["lang"], ["dice"]).withColumn("mean_dice", F.when(F.isnan("mean_dice"), None).otherwise(micro(F.col("mean_dice"))))


@query(f"WITH {_LABELS} SELECT DISTINCT label FROM atlas")
def agg32_distinct_labels(spark, sf):
    labels = _labels(spark, sf).select("vid", F.col("value").alias("label"))
    return rank.distinct_labels(labels)


# Registration


@query(f"WITH {VOL}, g AS (SELECT CAST(range % 16 AS INT) AS x, CAST(range // 16 % 16 AS INT) AS y, CAST(range // 256 AS INT) AS z FROM range(4096)), p AS (SELECT *, x * (7 / 15::DOUBLE) AS sx, y * (7 / 15::DOUBLE) AS sy, z * (7 / 15::DOUBLE) AS sz FROM g) SELECT p.x, p.y, p.z, {M('coalesce(2 * sum((1 - abs(sx - s.x)) * (1 - abs(sy - s.y)) * (1 - abs(sz - s.z)) * s.value), 0) + 1e-9')} AS dx, {M('coalesce(2 * sum((1 - abs(sx - s.x)) * (1 - abs(sy - s.y)) * (1 - abs(sz - s.z)) * s.n), 0) + 1e-9')} AS dz FROM p LEFT JOIN (SELECT * FROM vol WHERE greatest(x, y, z) < 8) s ON abs(sx - s.x) < 1 AND abs(sy - s.y) < 1 AND abs(sz - s.z) < 1 GROUP BY 1, 2, 3")
def reg5_enlarged_field(spark, sf):
    """A corner of the volume as a field on 8 x 8 x 8 voxels, ends aligned, with displacements twice as long on twice the grid."""
    f = S.volume(spark, sf).where("greatest(x, y, z) < 8").select("volume_id", "x", "y", "z", F.col("value").alias("dx"), F.lit(0.0).alias("dy"), F.col("n").cast("double").alias("dz"))
    out = registration.enlarge(f, (8, 8, 8), DIMS)
    return out.select("x", "y", "z", micro(F.col("dx") + 1e-9).alias("dx"), micro(F.col("dz") + 1e-9).alias("dz"))


def _moved(spark, volume, d):
    field = geometry.grid(volume, DIMS)
    return field.select("volume_id", "x", "y", "z", *(F.lit(float(v)).alias(c) for v, c in zip(d, ("dx", "dy", "dz"), strict=True)))


@query(f"WITH {VOL} SELECT x + 2 AS x, y, z - 3 AS z, value FROM vol WHERE x + 2 < 16 AND z - 3 >= 0")
def reg7_inverse_warp(spark, sf):
    """The inverse of a constant field moves voxels by it."""
    v = written(S.volume(spark, sf))
    out = registration.inverse_warp(v, _moved(spark, v, (2, 0, -3)), DIMS, True, 3)
    return out.where("value <> 0").select("x", "y", "z", "value")


@query(f"WITH {MASK} SELECT x - 1 AS x, y - 4 AS y, z FROM mask WHERE x >= 1 AND y >= 4")
def reg10_warp_mask(spark, sf):
    m = written(S.mask(spark, sf))
    return _ones(registration.warp_mask(m, _moved(spark, m, (1, 4, 0)), DIMS))


def _bent(volume, reach=1.0):
    """A velocity field that varies by place and by what the volume holds."""
    top = volume.agg(F.max("value").alias("top"))
    cells = geometry.grid(volume, DIMS).join(volume.select("volume_id", "x", "y", "z", "value"), ["volume_id", "x", "y", "z"], "left").crossJoin(F.broadcast(top))  # one row
    dx = reach * (3 * F.coalesce("value", F.lit(0.0)) / F.col("top") - 1)
    return cells.select("volume_id", "x", "y", "z", dx.alias("dx"), (reach * (F.col("x") / 8 - 1)).alias("dy"), (reach * (1.25 - F.col("y") / 4)).alias("dz"))


_BENT = f"""WITH {VOL}, g AS (SELECT CAST(range % 16 AS INT) AS x, CAST(range // 16 % 16 AS INT) AS y, CAST(range // 256 AS INT) AS z FROM range(4096)),
v AS (SELECT g.*, REACH * (3 * coalesce(value, 0) / (SELECT max(value) FROM vol) - 1) AS dx, REACH * (x / 8::DOUBLE - 1) AS dy, REACH * (1.25 - y / 4::DOUBLE) AS dz FROM g LEFT JOIN vol USING (x, y, z))"""


def _placed(field, name, clamp):
    at = ", ".join((f"least(15.0, greatest(0.0, {c} + d{c}))" if clamp else f"{c} + d{c}") + f" AS s{c}" for c in "xyz")
    return f"{name} AS (SELECT *, {at} FROM {field})"


def _near(p, s):
    return " AND ".join(f"abs({p}.s{c} - {s}.{c}) < 1" for c in "xyz")


_SHARE = " * ".join(f"(1 - abs(p.s{c} - s.{c}))" for c in "xyz")


def _squared(steps):
    """SQL of scaling and squaring: f0 is the velocity over 2 ** steps, each next one the last composed with itself."""
    out = [f"f0 AS (SELECT x, y, z, {', '.join(f'd{c} / {2**steps} AS d{c}' for c in 'xyz')} FROM v)"]
    for k in range(steps):
        sums = ", ".join(f"any_value(p.d{c}) + sum({_SHARE} * s.d{c}) AS d{c}" for c in "xyz")
        out += [_placed(f"f{k}", f"p{k}", True), f"f{k + 1} AS (SELECT p.x, p.y, p.z, {sums} FROM p{k} p JOIN f{k} s ON {_near('p', 's')} GROUP BY 1, 2, 3)"]
    return ", ".join(out)


_INSIDE = " AND ".join(f"p.s{c} BETWEEN 0 AND 15" for c in "xyz")


@query(f"{_BENT.replace('REACH', '1')}, {_squared(3)}, {_placed('f3', 'p', False)} SELECT p.x, p.y, p.z, {M(f'coalesce(sum(CASE WHEN {_INSIDE} THEN {_SHARE} * s.value END), 0)')} AS value FROM p LEFT JOIN vol s ON {_near('p', 's')} GROUP BY 1, 2, 3")
def reg4_warp(spark, sf):
    """A velocity field that varies, integrated in three steps over bricks of 8 voxels a side, and the volume warped by it."""
    v = written(S.volume(spark, sf))
    field = registration.integrate(_bent(v), DIMS, 3, side=8)
    out = registration.warp(v, field, DIMS, side=8)
    return out.select("x", "y", "z", micro(F.col("value")).alias("value"))


@query(f"{_BENT.replace('REACH', '4')}, {_placed('v', 'p', False)} SELECT p.x, p.y, p.z, s.value FROM p JOIN vol s ON floor(p.sx + 0.5) = s.x AND floor(p.sy + 0.5) = s.y AND floor(p.sz + 0.5) = s.z WHERE {_INSIDE}")
def reg6_far_warp(spark, sf):
    """REG-6: displacements of up to 8 voxels over bricks of 4 with a halo of 2: most come from the second pass. Nearest values."""
    v = written(S.volume(spark, sf))
    from ..operators import bricks

    field, source = bricks.to_bricks(_bent(v, 4.0), DIMS, ("dx", "dy", "dz"), 4), bricks.to_bricks(v, DIMS, side=4)
    out = bricks.from_bricks(bricks.sample(field, source, 1, nearest=True, halo=2, side=4), side=4, nonzero=True)
    return out.select("x", "y", "z", "value")


_BACK = ", ".join(f"b{k} AS (SELECT p.x, p.y, p.z, {', '.join(f'-sum({_SHARE} * s.d{c}) AS d{c}' for c in 'xyz')} FROM q{k} p JOIN v s ON {_near('p', 's')} GROUP BY 1, 2, 3), {_placed(f'b{k}', f'q{k + 1}', True)}" for k in range(2))


@query(f"{_BENT.replace('REACH', '1')}, z AS (SELECT x, y, z, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, 0.0::DOUBLE AS dz FROM v), {_placed('z', 'q0', True)}, {_BACK} SELECT x, y, z, {M('dx')} AS dx, {M('dy')} AS dy, {M('dz')} AS dz FROM b1")
def reg7_inverse_field(spark, sf):
    """REG-7: two fixed-point rounds towards the inverse of a field that varies."""
    v = written(S.volume(spark, sf))
    out = registration.inverse_field(_bent(v), DIMS, 2, side=8)
    return out.select("x", "y", "z", *(micro(F.col(c)).alias(c) for c in ("dx", "dy", "dz")))


@query(f"{_BENT.replace('REACH', '1')}, p AS (SELECT x, y, z, least(15, greatest(0, x * 1.5::DOUBLE - 3)) AS sx, least(15, y + 0.25::DOUBLE) AS sy, least(15.0, greatest(0.0, z + n / 8::DOUBLE - 2)) AS sz FROM vol) SELECT p.x, p.y, p.z, {', '.join(M(f'sum({_SHARE} * s.d{c}) + 1e-9') + f' AS d{c}' for c in 'xyz')} FROM p JOIN v s ON {_near('p', 's')} GROUP BY 1, 2, 3")
def reg8_sampled_vectors(spark, sf):
    """REG-8: vectors of a field that varies at places between voxels, and beyond the edge those of the edge."""
    v = written(S.volume(spark, sf))
    at = v.select("volume_id", "x", "y", "z", (F.col("x") * 1.5 - 3).alias("sx"), (F.col("y") + 0.25).alias("sy"), (F.col("z") + F.col("n") / 8 - 2).alias("sz"))
    out = registration.sample_field(at, _bent(v), DIMS)
    return out.select("x", "y", "z", *(micro(F.col(c) + 1e-9).alias(c) for c in ("dx", "dy", "dz")))


def _difference(moving, fixed):
    """A stub model: velocities by how two volumes differ."""
    import numpy as np

    return np.stack([2 * (moving - fixed), moving - 0.5, 0.5 - fixed])


_PAIRS = f"""WITH {VOL}, g AS (SELECT CAST(range % 16 AS INT) AS x, CAST(range // 16 % 16 AS INT) AS y, CAST(range // 256 AS INT) AS z FROM range(4096)),
f AS (SELECT g.*, coalesce(value, 0) / (SELECT max(value) FROM vol) AS a, coalesce(n, 0) / (SELECT max(n) FROM vol) AS b FROM g LEFT JOIN vol USING (x, y, z)), e AS (SELECT min(a) AS lo, max(a) AS hi FROM f),
src AS (SELECT x, y, z, (a - lo) / (hi - lo) AS value, b FROM f, e), v AS (SELECT x, y, z, 2 * (value - b) AS dx, value - 0.5 AS dy, 0.5 - b AS dz FROM src)"""


@query(f"{_PAIRS}, {_squared(3)}, {_placed('f3', 'p', False)} SELECT p.x, p.y, p.z, {M('any_value(sqrt(p.dx * p.dx + p.dy * p.dy + p.dz * p.dz))')} AS magnitude, {M(f'coalesce(sum(CASE WHEN {_INSIDE} THEN {_SHARE} * s.value END), 0)')} AS value FROM p LEFT JOIN src s ON {_near('p', 's')} GROUP BY 1, 2, 3")
def reg9_register_pairs(spark, sf):
    """REG-9: both volumes of a pair in one call of a stub model, its velocities integrated, and the moving volume warped."""
    v = elementwise.with_stats(written(S.volume(spark, sf)), top=F.max("value"), most=F.max("n"))
    cells = geometry.grid(v, DIMS).join(v, ["volume_id", "x", "y", "z"], "left")
    side = lambda c, top: cells.select("volume_id", "x", "y", "z", F.coalesce(F.col(c) / F.col(top), F.lit(0.0)).alias("value"))
    field, warped = registration.register_pairs(side("value", "top"), side("n", "most"), DIMS, _difference, steps=3, side=8)
    out = warped.join(field.select("x", "y", "z", "magnitude"), ["x", "y", "z"])
    return out.select("x", "y", "z", micro(F.col("magnitude")).alias("magnitude"), micro(F.col("value")).alias("value"))


# Scalar functions


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, regexp_replace(event_type || ' / ' || user_id, '[^A-Za-z0-9._-]+', '_', 'g') AS file, substr(sha1(event_type), 1, 8) AS digest FROM events")
def fn_event_strings(spark, sf):
    e = S.table(spark, sf, "events")
    name = F.concat("event_type", F.lit(" / "), F.col("user_id").cast("string"))
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), scalars.safe_filename(name).alias("file"), scalars.short_hash(F.col("event_type")).alias("digest"))


from . import asset_queries, grid_queries, group_queries, report_queries, source_queries, tree_queries  # noqa: E402, F401  they register their queries

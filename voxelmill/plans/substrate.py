"""Stand-in volumes made of the star-schema tables, in Spark and as SQL fragments for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

DIMS = (16, 16, 16)
PACK_DIMS = (4, 4, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16 x 16 x 16 volume: sums of quantity and counts of line items by residues of their keys."""
    items = table(spark, sf_dir, "lineitem")
    at = [(F.col(c) % 16).cast("int").alias(n) for c, n in zip(("l_partkey", "l_suppkey", "l_orderkey"), "xyz", strict=True)]
    cells = items.select(*at, "l_quantity").groupBy("x", "y", "z").agg(F.sum("l_quantity").alias("value"), F.count(F.lit(1)).alias("n"))
    return cells.select(F.lit("grid").alias("volume_id"), (F.col("x") + 16 * F.col("y") + 256 * F.col("z")).alias("vid"), "x", "y", "z", "value", "n")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels whose count is over mean plus one deviation."""
    v = written(volume(spark, sf_dir))
    cut = v.groupBy("volume_id").agg((F.avg("n") + F.stddev_pop("n")).alias("cut"))
    return v.join(F.broadcast(cut), "volume_id").where(F.col("n") > F.col("cut")).select("volume_id", "vid", "x", "y", "z", F.lit(1.0).alias("value"))  # one row a volume


def atlas(spark: SparkSession) -> DataFrame:
    v = F.col("id")
    cells = spark.range(4096).select(v.cast("int").alias("vid"), (v % 16).cast("int").alias("x"), (F.floor(v / 16) % 16).cast("int").alias("y"), F.floor(v / 256).cast("int").alias("z"), (v % 26).cast("int").alias("label"))
    return cells.where("label <> 0")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey between 1 and 24")
    return out.select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("parcel"), F.col("r_name").alias("network"))


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten channels of 4 x 4 x 4 maps: mean embeddings by label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("channel"), F.posexplode("embedding").alias("vid", "v"))
    return e.groupBy("channel", "vid").agg(F.avg(F.col("v").cast("double")).alias("t"))


def channel_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, network: channels 0 to 4 are the regions, the others have a network that no parcel has."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("channel"), F.col("r_name").alias("network"))
    rest = spark.range(5, 10).select(F.col("id").cast("int").alias("channel"), F.concat(F.lit("none-"), "id").alias("network"))
    return r.unionByName(rest)


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network, term, score, ord: brands of each part type with a score from the mean price."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("network"), F.col("p_brand").alias("term")).agg(F.avg("p_retailprice").alias("price"))
    return p.select("network", "term", (F.col("price") / 2000).alias("score"), F.crc32(F.col("term")).alias("ord"))


def type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network, fraction: shares of line items by part type."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    n = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("network")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("network", (F.col("n") / F.col("total")).alias("fraction"))


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predicted (toxic) and true (quality) documents as sparse masks by language and source."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("lang", "source", F.col("doc_id").alias("vid"), "quality", "toxic")
    return d.where("toxic = 1").drop("quality", "toxic"), d.where("quality = 1").drop("quality", "toxic")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, region, t, value: event values by user residue, event type and hour."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 7).cast("int").alias("subject"), F.col("event_type").alias("region"), F.hour("ts").alias("t"), "value")


#: Grids of three kinds of volumes, by return flag: dims and affine, one with an axis turned round, one with axes changed.
KINDS = {
    "A": ((10, 12, 8), ((1.0, 0, 0, 0), (0, 2.0, 0, -3), (0, 0, 1.5, 0.25))),
    "N": ((12, 11, 9), ((-1.5, 0, 0, 12), (0, 2.0, 0, 1), (0, 0, 1.0, 0))),
    "R": ((14, 10, 10), ((0, 1.25, 0, 0), (0, 0, 2.0, 1), (-1.0, 0, 0, 10))),
}
TARGET = (7, 7, 7), ((2.25, 0, 0, 0.3), (0, 3.0, 0, 0.2), (0, 0, 2.0, 0.4))


def grid_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse volumes of different grids, one for each return flag and block of 50 suppliers, so that their number grows with the tables."""
    flag = F.col("l_returnflag")
    n = {c: F.coalesce(*(F.when(flag == k, d[i]) for k, (d, _) in KINDS.items())) for i, c in enumerate("xyz")}
    at = {"x": F.col("l_partkey") % n["x"], "y": F.col("l_orderkey") % n["y"], "z": (3 * F.col("l_linenumber") + F.col("l_partkey")) % n["z"]}
    name = F.concat(flag, F.lit("-"), F.floor(F.col("l_suppkey") / 50).cast("string"))
    cells = table(spark, sf_dir, "lineitem").select(name.alias("volume_id"), *(c.cast("int").alias(k) for k, c in at.items()), "l_quantity")
    return cells.groupBy("volume_id", "x", "y", "z").agg(F.sum("l_quantity").alias("value"), F.count(F.lit(1)).alias("n"))


def grid_meta(volumes: DataFrame) -> DataFrame:
    """volume_id, nx, ny, nz, affine of each of these volumes."""
    flag = F.substring("volume_id", 1, 1)
    ids = volumes.select("volume_id").distinct()
    rows = lambda m: F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in [*m, (0, 0, 0, 1)]))
    dims = [F.coalesce(*(F.when(flag == k, d[i]) for k, (d, _) in KINDS.items())).alias(c) for i, c in enumerate(("nx", "ny", "nz"))]
    return ids.select("volume_id", *dims, F.coalesce(*(F.when(flag == k, rows(m)) for k, (_, m) in KINDS.items())).alias("affine"))


def micro(c):
    """Millionths, rounded half up, as a whole number that both engines hash alike."""
    return F.floor(c * 1_000_000 + 0.5).cast("long")


VOL = """cells AS (SELECT CAST(l_partkey % 16 AS INT) AS x, CAST(l_suppkey % 16 AS INT) AS y, CAST(l_orderkey % 16 AS INT) AS z, sum(l_quantity) AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
vol AS (SELECT x + 16 * y + 256 * z AS vid, x, y, z, value, n FROM cells)"""
MASK = VOL + """, mask AS (SELECT vid, x, y, z FROM vol WHERE n > (SELECT avg(n) + stddev_pop(n) FROM vol)),
atlas AS (SELECT CAST(range AS INT) AS vid, CAST(range % 26 AS INT) AS label FROM range(4096) WHERE range % 26 <> 0),
names AS (SELECT n_nationkey AS label, n_name AS parcel, r_name AS network FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey BETWEEN 1 AND 24)"""
OVERLAP = MASK + """, hits AS (SELECT coalesce(label, 0) AS label, count(*) AS voxels FROM mask LEFT JOIN atlas USING (vid) GROUP BY 1),
sizes AS (SELECT label, count(*) AS parcel_size FROM atlas GROUP BY 1), total AS (SELECT sum(voxels) AS total FROM hits),
parcels AS (SELECT label, parcel_size, voxels, voxels / parcel_size AS fp, voxels / total AS fl FROM hits JOIN sizes USING (label), total WHERE label <> 0),
summary AS (SELECT coalesce(network, 'Unassigned') AS network, CAST(sum(voxels) AS BIGINT) AS voxels, sum(fl) AS fraction, list_sort(list(label)) AS parcels FROM parcels LEFT JOIN names USING (label) GROUP BY 1)"""
PACK = """pack AS (SELECT channel, vid, avg(CAST(v AS DOUBLE)) AS t FROM (SELECT label AS channel, unnest(range(64)) AS vid, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2),
channels AS (SELECT r_regionkey AS channel, r_name AS network FROM region UNION ALL SELECT CAST(range AS INT), 'none-' || range FROM range(5, 10))"""
CASES = """d AS (SELECT lang, source, doc_id AS vid, quality, toxic FROM documents JOIN labels USING (doc_id))"""
GRIDS = """kinds AS (SELECT * FROM (VALUES ('A', 10, 12, 8), ('N', 12, 11, 9), ('R', 14, 10, 10)) t(flag, nx, ny, nz)),
gv AS (SELECT concat(l_returnflag, '-', l_suppkey // 50) AS volume_id, flag, nx, ny, nz, CAST(l_partkey % nx AS INT) AS x, CAST(l_orderkey % ny AS INT) AS y, CAST((3 * l_linenumber + l_partkey) % nz AS INT) AS z, sum(l_quantity) AS value, count(*) AS n FROM lineitem JOIN kinds ON flag = l_returnflag GROUP BY ALL),
gm AS (SELECT DISTINCT volume_id, flag, nx, ny, nz FROM gv)"""
#: Places of the target grid's voxels in each volume's own grid, by the inverse of its affine.
PLACED = GRIDS + """, cell AS (SELECT volume_id, flag, CAST(range % 7 AS INT) AS x, CAST(range // 7 % 7 AS INT) AS y, CAST(range // 49 AS INT) AS z, 2.25::DOUBLE * (range % 7) + 0.3 AS wx, 3.0::DOUBLE * (range // 7 % 7) + 0.2 AS wy, 2.0::DOUBLE * (range // 49) + 0.4 AS wz FROM gm, range(343)),
placed AS (SELECT volume_id, x, y, z, CASE flag WHEN 'A' THEN wx WHEN 'N' THEN (12 - wx) / 1.5 ELSE 10 - wz END AS sx, CASE flag WHEN 'A' THEN (wy + 3) / 2 WHEN 'N' THEN (wy - 1) / 2 ELSE wx / 1.25 END AS sy, CASE flag WHEN 'A' THEN (wz - 0.25) / 1.5 WHEN 'N' THEN wz ELSE (wy - 1) / 2 END AS sz FROM cell)"""
SERIES = """s AS (SELECT CAST(user_id % 7 AS INT) AS subject, event_type AS region, hour(ts) AS t, value FROM events)"""


def micro_sql(expression: str) -> str:
    return f"CAST(floor(({expression}) * 1000000 + 0.5) AS BIGINT)"

"""Queries over assets and their files, cases, and small report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import elementwise, overlap, score
from ..session import new_folder, written
from ..sources import assets, nifti
from . import substrate as S
from .queries import _LABELS, _WINDOW, _labels, _slope_scorer
from .registry import query
from .substrate import DIMS, OVERLAP, VOL, micro
from .substrate import micro_sql as M


def _manifest(spark, sf):
    """Parts as assets: every third is supported, sizes by price."""
    p = S.table(spark, sf, "part")
    status = F.when(F.col("p_partkey") % 3 == 0, assets.SUPPORTED).otherwise("planned")
    return p.select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), status.alias("supportStatus"), F.floor(F.col("p_retailprice") * 100).cast("long").alias("sizeBytes"), "p_name")


@query("SELECT CAST(sum(CAST(floor(p_retailprice * 100) AS BIGINT)) FILTER (WHERE p_partkey % 3 = 0) AS BIGINT) AS bytes FROM part")
def agg33_budget(spark, sf):
    return assets.budget(_manifest(spark, sf))


@query("SELECT 'part-' || p_partkey AS id, p_name FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part WHERE p_partkey % 3 = 0)")
def jn14_lookup(spark, sf):
    """The last supported part, by its id."""
    last = S.table(spark, sf, "part").where("p_partkey % 3 = 0").agg(F.max("p_partkey")).first()[0]
    row = assets.lookup(_manifest(spark, sf), f"part-{last}")
    return spark.createDataFrame([(row.id, row.p_name)], "id string, p_name string")


@query("SELECT id, count(*) AS n FROM (SELECT n_name AS id FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer) GROUP BY 1 HAVING count(*) > 1")
def set5_repeated_ids(spark, sf):
    one = lambda t, c: S.table(spark, sf, t).select(F.col(c).alias("id"))
    return assets.repeated_ids(one("nation", "n_name"), one("region", "r_name"), one("customer", "c_mktsegment"))


@query("WITH t AS (SELECT o_orderkey AS ord, unnest([o_orderpriority, 'c' || o_custkey % 50]) AS subject FROM orders) SELECT DISTINCT trim(subject) AS subject FROM t")
def set3_subjects(spark, sf):
    """Subjects from comma-separated tokens, each once."""
    tokens = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.concat("o_orderpriority", F.lit(" , ,c"), (F.col("o_custkey") % 50).cast("string"), F.lit(",")).alias("tokens"))
    return scalars.expand_subjects(tokens)


@query("SELECT n_nationkey AS key, n_name AS name, NULL AS comment FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def snk6_union_of_columns(spark, sf):
    n = S.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    r = S.table(spark, sf, "region").select(F.col("r_name").alias("comment"), F.col("r_regionkey").alias("key"))
    return assets.union_of_columns([n, r])


@query(f"WITH {OVERLAP} SELECT network, voxels, printf('%.1f', 100 * fraction) AS pct FROM summary")
def snk10_percent_table(spark, sf):
    out = overlap.network_rollup(overlap.parcel_overlap(S.mask(spark, sf), S.atlas(spark)), S.names(spark, sf))
    return overlap.percent_table(out).select("network", "voxels", "pct")


@query(f"WITH {_LABELS} SELECT CAST(vid AS BIGINT) AS vid, x, y, z, label FROM atlas")
def src5_read_atlas(spark, sf):
    """SRC-5, PRJ-21: an atlas named by a manifest that has its grid, loaded from its file."""
    folder = new_folder(spark, "atlas")
    nifti.write_files(nifti.to_files(_labels(spark, sf).withColumn("volume_id", F.lit("labels")), DIMS, labels=True), folder)
    listed = spark.createDataFrame([("counts", "planned", [1, 1, 1], "none.nii"), ("counts", assets.SUPPORTED, list(DIMS), "labels.nii.gz")], "id string, supportStatus string, dims array<int>, filename string")
    return assets.read_atlas(spark, listed, "counts", folder)


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, 2 AS reads FROM lineitem GROUP BY 1")
def src11_cached(spark, sf):
    """A table made once under its key; the second request reads it."""
    folder, made = new_folder(spark, "cache"), []

    def make():
        made.append(1)
        return S.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))

    for _ in range(2):
        out = assets.cached(spark, "flags-v1", folder, make)
    return out.withColumn("reads", F.lit(len(made) + 1))


def _named(spark, sf):
    """Names of nations as files, of which those of one region aren't there and every fifth differs from its checksum."""
    folder = new_folder(spark, "files")
    n = S.table(spark, sf, "nation")
    nifti.write_files(n.where("n_regionkey <> 2").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("volume_id"), F.encode("n_name", "utf-8").alias("content")), folder, ".bin")
    wrong = F.when(F.col("n_nationkey") % 5 == 0, "x").otherwise("")
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    return folder, n.select(name.alias("id"), F.concat(name, F.lit(".bin")).alias("filename"), F.sha2(F.concat("n_name", wrong), 256).alias("checksum"))


@query("SELECT 'n' || n_nationkey AS id, CASE WHEN n_regionkey <> 2 THEN 1 ELSE 0 END::BIGINT AS found, n_regionkey <> 2 AND n_nationkey % 5 <> 0 AS ok FROM nation")
def src13_checksums(spark, sf):
    folder, listed = _named(spark, sf)
    return assets.checksums(spark, folder, listed)


@query("SELECT sha256(string_agg(n_name, ',' ORDER BY n_nationkey)) AS digest, CAST(strlen(string_agg(n_name, ',' ORDER BY n_nationkey)) AS BIGINT) AS bytes FROM nation")
def src12_fetch_model(spark, sf):
    """The first copy is missing, the second too small, the third is taken."""
    folder = new_folder(spark, "models")
    names = S.table(spark, sf, "nation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ",").alias("t"))
    copies = names.select(F.lit("small").alias("volume_id"), F.encode(F.substring("t", 1, 40), "utf-8").alias("content")).unionByName(names.select(F.lit("whole").alias("volume_id"), F.encode("t", "utf-8").alias("content")))
    nifti.write_files(copies, folder, ".onnx")
    raw = assets.fetch_model(spark, [f"{folder}/{n}.onnx" for n in ("none", "small", "whole")], 100)
    return spark.createDataFrame([(bytearray(raw),)], "raw binary").select(F.sha2("raw", 256).alias("digest"), F.length("raw").cast("long").alias("bytes"))


@query("""WITH l AS (SELECT DISTINCT 'n' || s_nationkey || '_c' || s_suppkey % 3 AS stem FROM supplier), m AS (SELECT DISTINCT 'n' || s_nationkey || '_c' || s_suppkey % 3 AS stem FROM supplier WHERE s_acctbal > 0)
SELECT 'n' || n_nationkey AS subject, 'c' || c AS contrast, stem || '.nii' AS image, CASE WHEN m.stem IS NOT NULL THEN stem || '_mask.nii' END AS mask FROM nation, range(3) t(c) JOIN l ON l.stem = 'n' || n_nationkey || '_c' || c LEFT JOIN m USING (stem)""")
def src16_cases(spark, sf):
    """Cases by listed files, with or without a mask."""
    s = S.table(spark, sf, "supplier")
    stem = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("_c"), (F.col("s_suppkey") % 3).cast("string"))
    listing = s.select(F.concat(stem, F.lit(".nii")).alias("path")).union(s.where("s_acctbal > 0").select(F.concat(stem, F.lit("_mask.nii")))).distinct()
    subjects = S.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("subject"))
    return assets.discover_cases(subjects, ["c0", "c1", "c2"], listing, "%s_%s.nii", "%s_%s_mask.nii", False)


@query(f"{_WINDOW.replace('WAYS', '(1, 1.0::DOUBLE)')} SELECT px, py, pz, {M('min(q)')} AS low, {M('max(q)')} AS high, {M('avg(q)')} AS mean FROM scored SEMI JOIN vol USING (x, y, z) GROUP BY 1, 2, 3 ORDER BY pz, py, px LIMIT 5")
def agg20_patch_stats(spark, sf):
    """Figures of the first five patches, in raster order."""
    from ..operators.geometry import patch_voxels

    v = elementwise.z_score(written(S.volume(spark, sf)))
    scored = score.score_patches(patch_voxels(v, DIMS, (8, 8, 8), 0.25), (8, 8, 8), _slope_scorer)
    out = score.patch_stats(scored)
    return out.select("px", "py", "pz", *(micro(F.col(c)).alias(c) for c in ("low", "high", "mean")))


@query(f"WITH {VOL} SELECT vid, CAST(n % 26 AS INT) AS label FROM vol WHERE n % 26 > 0")
def prj21_label_base(spark, sf):
    labels = S.volume(spark, sf).select("vid", (F.col("n") % 26).cast("int").alias("label"))
    return elementwise.label_base(labels)

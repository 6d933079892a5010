"""Asset manifests: lookup, checks of ids and checksums, budgets, and cached copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.elementwise import clean_label, label_base
from . import nifti

SUPPORTED = "supported"
MIN_MODEL_BYTES = 100_000


def lookup(assets: DataFrame, asset_id: str):
    """The one supported asset of an id; raises if there is none."""
    row = assets.where((F.col("id") == asset_id) & (F.col("supportStatus") == SUPPORTED)).first()
    if row is None:
        raise ValueError(f"no supported asset {asset_id}")
    return row


def load_atlas(assets: DataFrame, asset_id: str, meta_dims) -> tuple[int, ...]:
    """Checks the dims of a loaded atlas against its manifest."""
    row = lookup(assets, asset_id)
    if tuple(row.dims) != tuple(meta_dims):
        raise ValueError(f"{asset_id} has dims {tuple(meta_dims)}, its manifest {tuple(row.dims)}")
    return tuple(row.dims)


def read_atlas(spark: SparkSession, assets: DataFrame, asset_id: str, folder: str) -> DataFrame:
    """vid, x, y, z, label of a supported atlas, from its NIfTI file under the folder; raises where its grid isn't the manifest's or it isn't there.

    Labels are rounded, and background is left out.
    """
    row = lookup(assets, asset_id)
    path = f"{folder}/{row.filename}"
    meta = nifti.read_meta(spark, path).select("nx", "ny", "nz").first()
    load_atlas(assets, asset_id, tuple(meta))
    voxels = nifti.read_voxels(spark, path, scaled=True, nonzero=True)
    return label_base(voxels.select("vid", "x", "y", "z", clean_label(F.col("value")).cast("int").alias("label")))


def repeated_ids(*registries: DataFrame) -> DataFrame:
    """Ids that occur more than once over all registries."""
    ids = registries[0].select("id")
    for r in registries[1:]:
        ids = ids.unionAll(r.select("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def budget(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("supportStatus") == SUPPORTED).agg(F.coalesce(F.sum("sizeBytes"), F.lit(0)).alias("bytes"))


def checksums(spark: SparkSession, folder: str, assets: DataFrame) -> DataFrame:
    """id, found and ok: whether a copy under the folder has the manifest's SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha"))
    joined = assets.select("id", "filename", "checksum").join(files, "filename", "left")
    return joined.groupBy("id").agg(F.count("sha").alias("found"), F.coalesce(F.max(F.col("sha") == F.col("checksum")), F.lit(False)).alias("ok"))


def cached(spark: SparkSession, key: str, folder: str, make) -> DataFrame:
    """The table under ``folder/key``, made and written there the first time."""
    path = f"{folder}/{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fetch_model(spark: SparkSession, paths: list[str], least: int = MIN_MODEL_BYTES) -> bytes:
    """The first readable copy of a model that isn't too small; the last path is tried twice."""
    error = None
    for path in [*paths, paths[-1]]:
        try:
            row = spark.read.format("binaryFile").load(path).select("content", "length").first()
            if row is not None and row.length > least:
                return bytes(row.content)
            error = ValueError(f"{path} is too small for a model")
        except Exception as e:  # the next copy is tried
            error = e
    raise error


def discover_cases(subjects: DataFrame, contrasts: list[str], listing: DataFrame, image: str, mask: str, paired: bool = True) -> DataFrame:
    """subject, contrast, image, mask of every case whose files are listed; a paired case needs both.

    image and mask are printf templates of subject and contrast; listing has a column path.
    """
    named = subjects.select("subject", F.explode(F.array(*map(F.lit, contrasts))).alias("contrast"))
    named = named.withColumns({"image": F.format_string(image, "subject", "contrast"), "mask": F.format_string(mask, "subject", "contrast")})
    out = named.join(listing.select(F.col("path").alias("image")), "image", "left_semi")
    have = listing.select(F.col("path").alias("mask"), F.lit(True).alias("has_mask"))
    out = out.join(have, "mask", "left")
    return (out.where("has_mask") if paired else out).select("subject", "contrast", "image", F.when(F.col("has_mask"), F.col("mask")).alias("mask"))


def missing_files(required: DataFrame, listing: DataFrame) -> DataFrame:
    return required.join(listing.select("path").distinct(), "path", "left_anti")


def union_of_columns(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables with the union of their columns in first-seen order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out

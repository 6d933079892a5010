"""Intermediate tables in the shared folder, and small helpers that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, SparkSession] = {}


#: Bytes of a batch that a task works on at once.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], keep_words: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about SLICE_BYTES, so that long texts don't add up to large lists. When a task ends, it gives the memory it freed back to the machine.

    Tasks that don't encode texts first drop the words that their worker has kept from those that do.
    """
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens is not None and not keep_words:
        tokens.forget()
    try:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for a in range(0, batch.num_rows, step):
                yield batch.slice(a, step)
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries
            ctypes.CDLL(None).malloc_trim(0)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(spark: SparkSession) -> None:
    """Collects garbage on the driver, so that Spark removes shuffle files which no table refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor costs only its tasks.

    The shuffle files of this write go when it is done, those of the steps before that nothing refers to any more go first.
    """
    spark = df.sparkSession
    free(spark)
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxelmill_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a materialised table that no later step reads."""
    path = getattr(df, "_voxelmill_path", None)
    if path and path in _made:
        _delete(_made.pop(path), path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):
            _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row, a struct; rows equal in all these columns share it. Nulls count as a value of their own."""
    parts = [c for name in columns for c in (F.col(name).isNull(), F.col(name))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def number_rows(df: DataFrame, groups: list[str], order: list[str], salt: Column, salts: int, name: str) -> DataFrame:
    """Adds column ``name``: 0, 1, ... without gaps within each group, in an order fixed by (salt, order).

    Rows are ranked within (group, salt) and the counts of a group's salts are summed before them,
    so that no task holds a whole group. df is read twice and should be materialised.
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    keys = [*groups, "_salt"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    out = ranked.join(counts, keys)
    return out.withColumn(name, (F.col("_rank") + F.col("_before")).cast("long")).drop("_salt", "_rank", "_before")

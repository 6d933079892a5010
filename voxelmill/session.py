"""Makes the package importable on executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application once, so that functions pickled by reference load on any executor."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.NamedTemporaryFile(suffix="-voxelmill.zip", delete=False) as f:
        with zipfile.ZipFile(f, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "voxelmill")):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(f.name)
    atexit.register(os.unlink, f.name)  # executors fetch it from the driver until then
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset on one machine, as in tests, a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="voxelmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_made: dict[str, SparkSession] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what comes after reads it, however often, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

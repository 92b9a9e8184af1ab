"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folder: str | None = None
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of this process is made, and removed when the process ends. That
    works only if there is one machine, so it is an error with any other master than ``local``.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(
            f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share"
        )
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="pitchlens-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    For frames that several branches of one plan need: it is computed once, its lineage is
    cut, and it survives the loss of executors. ``partition_by`` names columns that readers filter.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    if partition_by:
        stored = stored.select(*df.columns)
    _stored[stored] = path
    return stored


def small_or_plain(df: DataFrame, label: str, most: int = 10_000) -> DataFrame:
    """Store ``df``, and mark it for a broadcast only if it has at most ``most`` rows."""
    stored = stage(df, label)
    return F.broadcast(stored) if stored.count() <= most else stored


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows; ``path`` may be a URI."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if "%" in path else path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _written:
        _written.remove(path)


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``stage`` has returned and that no plan reads any more."""
    for frame in frames:
        delete_path(frame.sparkSession, _stored.pop(frame))


def discard_all(spark: SparkSession) -> int:
    """Delete everything that this process has put into the shared folder; returns how many.

    To be called when no frame of the library is in use any more.
    """
    paths = list(_written)
    for path in paths:
        delete_path(spark, path)
    return len(paths)

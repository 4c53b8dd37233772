"""The folder that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

_own_folder: str | None = None

# By application: the paths to remove when it ends, and the copies that are written once.
_paths: dict[str, list[str]] = {}
_copies: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, or as its checkpoint folder.

    Only a local session may leave it unset (all its tasks run on this machine); it then
    gets one temporary folder per process. On a cluster a missing setting is an error,
    because a driver-local folder would be lost or invisible to the executors.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    global _own_folder
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="gradeweave-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def enable_checkpoints(spark: SparkSession) -> None:
    """Give the context a checkpoint folder where the session has not named one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
        # Spark makes a folder of its own in there.
        remove_at_end(spark, context.getCheckpointDir())


def _hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Hadoop's classes."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove the path, which must exist, when the driver's JVM ends; ``remove_written`` does so
    earlier. Any file system of Hadoop's cache will do, as all are unless a setting
    ``fs.*.impl.disable.cache`` keeps them out. A driver that is killed leaves its files.
    """
    hadoop_path, files = _hadoop_path(spark, path)
    files.deleteOnExit(hadoop_path)
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)


def remove_written(spark: SparkSession) -> list[str]:
    """Remove now what this application has written to the shared folder, and return its paths.

    DataFrames that read those files can no longer be used; ``written`` and ``shared_copy``
    can, and write anew. Call it before ``spark.stop()`` where the process lives on.
    """
    application = spark.sparkContext.applicationId
    for of in [of for of in _copies if of[0] == application]:
        del _copies[of]
    paths = _paths.pop(application, [])
    for path in paths:
        hadoop_path, files = _hadoop_path(spark, path)
        files.delete(hadoop_path, True)
        files.cancelDeleteOnExit(hadoop_path)
    return paths


def shared_copy(spark: SparkSession, name: str, write: Callable[[str], object]) -> str:
    """A folder that ``write(folder)`` fills once per ``name`` and session.

    ``name`` must tell everything that is written, the input's place included: the copy does
    not follow later changes of its input. A write that fails is tried again by the next call.
    """
    of = (spark.sparkContext.applicationId, name)
    if of not in _copies:
        path = new_path(spark, "copy")
        try:
            write(path)
        finally:
            remove_at_end(spark, path)
        _copies[of] = path
    return _copies[of]


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder once and read back.

    For a result that is costly to compute and needed more than once, or whose size must be
    known before the next step is planned: the planner sees the size of the files. Losing
    an executor does not lose it. The files go when the session ends (``remove_at_end``).
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    try:
        df.write.parquet(path)
    finally:
        remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)

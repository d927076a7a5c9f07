"""Tables written once into the folder that every executor sees, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_written: set[str] = set()
#: Spark's setting that removes an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``. Where it is unset, a temporary one for a local
    master, as in tests; on a cluster an error, as each executor would write to its own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="skein-shared-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return _own_dirs[app]


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _path(spark, path)
    return system.exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        system, target = _path(spark, path)
        system.delete(target, True)
    except Exception:  # the session has ended: the folder is left to its owner
        pass
    _written.discard(path)


def write_table(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    """``df`` written as Parquet and read back. As nothing of the execution is used again, its shuffle files go at its
    end. A path that exists is an error."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder and read back, which cuts its lineage.

    A lost executor costs a re-read of the table, not a re-run of what made it. The table goes when it is discarded, at
    the latest when the driver's Python ends.
    """
    path = fresh_path(df.sparkSession, name)
    kept = write_table(df, path)
    kept._skein_path = path
    return kept


def discard(kept: DataFrame) -> None:
    """Removes the files of a materialised table that nothing reads any more."""
    path = getattr(kept, "_skein_path", None)
    if path in _written:
        _remove(kept.sparkSession, path)

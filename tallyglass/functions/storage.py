"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What this process has written there and not removed yet.
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it isn't set: a temporary folder for a session of one machine, an error for a cluster, whose executors wouldn't see it."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tallyglass-")
        atexit.register(shutil.rmtree, where, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path there that nothing has yet; remove_written() removes what is at it."""
    path = f"{shared_dir(spark)}/tallyglass-{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: what several plans read is computed once, and a lost executor costs nothing."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage; the copy is in the shared folder, so a lost executor costs nothing. Spark removes it with spark.cleaner.referenceTracking.cleanCheckpoints."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_written(spark: SparkSession, paths: set[str] | None = None) -> int:
    """Removes what this process has written to the shared folder (of it, `paths`), once no result that reads it is needed any more; returns how many paths."""
    removed = 0
    for path in list(_WRITTEN if paths is None else paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
        _WRITTEN.discard(path)
    return removed


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is written inside is removed at the end, and so are the shuffle files of plans that nothing refers to any more (Spark does when the driver collects garbage)."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        remove_written(spark, _WRITTEN - before)
        gc.collect()
        spark._jvm.System.gc()

"""Tables in the shared folder that operators of several passes write their state to."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where each table that cut() gave back lies.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


class _Written(threading.local):
    """The tables that this thread wrote, in their order; calls that run in other threads have lists of their own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_WRITTEN = _Written()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the folder that spark.checkpoint.dir names; only a local session gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-sparkloom-")
    sc.setCheckpointDir(named)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them from there.

    A lost executor then costs no recomputation of what came before, and the rows are computed once (a checkpoint of the
    RDD computes them twice). discard() deletes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    _WRITTEN.paths.append(path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote; others are left alone."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path is not None:
            if path in _WRITTEN.paths:
                _WRITTEN.paths.remove(path)
            remove(df.sparkSession, path)


def mark() -> int:
    """A point in time of this thread for discard_since()."""
    return len(_WRITTEN.paths)


def discard_since(spark: SparkSession, at: int) -> None:
    """Deletes all tables that cut() wrote in this thread after mark() gave ``at``; for callers whose results are stored elsewhere."""
    while len(_WRITTEN.paths) > at:
        remove(spark, _WRITTEN.paths.pop())


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """cut() of what ``make`` gives; the tables that it wrote on its way are deleted."""
    at = mark()
    out = cut(make())
    kept = _WRITTEN.paths.pop()
    discard_since(out.sparkSession, at)
    _WRITTEN.paths.append(kept)
    return out

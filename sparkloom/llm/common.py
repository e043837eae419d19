"""Helpers shared by the text operators: reading tables, Arrow stages, and those of the library for tables in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.casts import free_name
from ..sources.scratch import cut, discard, discard_since, ensure_checkpoint_dir, mark, remove, settled, shared_path

__all__ = [
    "ascii_lower", "cut", "discard", "discard_since", "ensure_checkpoint_dir", "free_name", "map_arrow", "mark", "on_workers", "remove", "settled", "shared_path", "table", "texts_of",
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, if it isn't installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only and leaves every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    on_workers(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of each row's text; a null counts as empty."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


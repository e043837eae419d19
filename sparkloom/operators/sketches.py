"""Profiles of batches that merge into the profile of all of them, without the rows of earlier batches.

A sketch is a table with a row for each column: how many rows and nulls, the smallest and largest text, a HyperLogLog
sketch of the different values and a sample of them, the ones whose hashes are smallest. All of these merge: counts add
up, HyperLogLog sketches unite, and the smallest hashes of all are among the smallest of each. Sketches of batches are
kept as tables, and merged ones are sketches again.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .profile import value_frequencies

#: Values of a sample; 2^LOG_SIZE registers of a HyperLogLog sketch, whose estimate is off by 1.04 / sqrt(2^LOG_SIZE) or so.
SAMPLE, LOG_SIZE = 10, 14


def _hash(value: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), value).cast("binary"))


def _smallest(values: DataFrame, n: int) -> DataFrame:
    """col_name and sample (hash, value; by hash) from different (col_name, hash, value)."""
    place = F.row_number().over(Window.partitionBy("col_name").orderBy("hash", "value"))
    first = values.withColumn("_place", place).where(F.col("_place") <= n)  # Spark keeps n a task before it shuffles
    return first.groupBy("col_name").agg(F.sort_array(F.collect_list(F.struct("hash", "value"))).alias("sample"))


def sketch(df: DataFrame, seed: int = 0, sample: int = SAMPLE) -> DataFrame:
    """col_name, rows, nulls, low, high, distinct (a HyperLogLog sketch) and sample of each column.

    Values are taken as texts, as in profile(). A column of nulls has no low, high and sample; an empty table gives no rows,
    which merge like others. The sample depends on the seed and the values alone.
    """
    freq = value_frequencies(df)
    counted = freq.groupBy("col_name").agg(
        F.sum("count").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("nulls"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.hll_sketch_agg("value", F.lit(LOG_SIZE)).alias("distinct"),
    )
    known = freq.where("value IS NOT NULL").select("col_name", _hash(F.col("value"), seed).alias("hash"), "value")
    return counted.join(_smallest(known, sample), "col_name", "left")


def merge(*sketches: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The sketch of all rows of which these are the sketches (with one seed), from their few rows alone."""
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    counted = every.groupBy("col_name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("distinct").alias("distinct")
    )
    known = every.select("col_name", F.inline("sample")).distinct()
    return counted.join(_smallest(known, sample), "col_name", "left")


def estimates(sketched: DataFrame) -> DataFrame:
    """col_name, total_count, null_count, unique_estimate, low, high and sample_values (by their hashes) of a sketch."""
    return sketched.select(
        "col_name",
        F.col("rows").alias("total_count"),
        F.col("nulls").alias("null_count"),
        F.hll_sketch_estimate("distinct").alias("unique_estimate"),
        "low",
        "high",
        F.coalesce(F.col("sample.value"), F.array().cast("array<string>")).alias("sample_values"),
    )

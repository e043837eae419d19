"""Exact quantiles and modes of many columns, no task of which holds all values of a column.

Values are counted, the distinct ones split into ranges of (column, value), and the counts of the ranges summed up. Each
wanted rank then lies in one known range, and only that range's running sums are looked at.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions.casts import number
from ..sources.scratch import cut

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numbers_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """col_name, x and n: the numbers in the columns, x being null where a value is none; NaN counts as none."""
    dtypes = dict(df.dtypes)

    def read(c: str):
        x = F.col(f"`{c}`")
        if not dtypes[c].startswith(_NUMERIC):
            return number(x)
        return F.nanvl(x.cast("double"), F.lit(None).cast("double"))

    wide = df.select(*(read(c).alias(c) for c in columns))
    return wide.unpivot([], [F.col(f"`{c}`") for c in columns], "col_name", "x").withColumn("n", F.lit(1).cast("long"))


def ranked(values: DataFrame) -> DataFrame:
    """The distinct values (col_name, x) with their counts n and the range ``part`` that they are in, as a table."""
    counted = values.groupBy("col_name", "x").agg(F.sum("n").alias("n"))
    return cut(counted.repartitionByRange("col_name", "x").withColumn("part", F.spark_partition_id()))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """col_name and q, the values at the shares with linear interpolation, of a table that ranked() gave; nulls don't count."""
    known = table.where("x IS NOT NULL")
    sums = known.groupBy("col_name", "part").agg(F.sum("n").alias("n"))  # a row for each column and range
    running = Window.partitionBy("col_name").orderBy("part")
    sums = sums.select("col_name", "part", "n", (F.sum("n").over(running) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("col_name")).alias("total"))
    at = F.transform(F.array(*map(F.lit, shares)), lambda s: s * (F.col("total") - 1))
    ranks = F.concat(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x)))
    wanted = sums.select("col_name", "part", "n", "before", "total", F.posexplode(ranks).alias("i", "rank"))
    wanted = wanted.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).drop("n")
    parts = wanted.select("col_name", "part", "before").distinct()
    # Two ranges a share and column at most.
    inside = known.join(F.broadcast(parts), ["col_name", "part"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("col_name", "part").orderBy("x"))
    inside = inside.select("col_name", "part", "x", upto.alias("upto"))
    found = inside.join(F.broadcast(wanted.drop("before")), ["col_name", "part"]).where("upto > rank")
    found = found.groupBy("col_name", "total", "i").agg(F.min("x").alias("x"))
    found = found.groupBy("col_name", "total").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("v"))

    def between(i: int, share: float):
        low, high = F.col("v")[F.lit(i)], F.col("v")[F.lit(i + len(shares))]
        place = F.lit(float(share)) * (F.col("total") - 1)
        return low + (high - low) * (place - F.floor(place))

    return found.select("col_name", F.array(*(between(i, s) for i, s in enumerate(shares))).alias("q"))


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The most frequent value of each column (the smallest of several) as text; a row a column reaches the driver."""
    found = None
    for i, c in enumerate(columns):
        counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        top = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m")).select(F.lit(i).alias("i"), F.col("m.v").cast("string").alias("v"))
        found = top if found is None else found.unionByName(top)
    return {columns[r["i"]]: r["v"] for r in found.collect()} if found is not None else {}

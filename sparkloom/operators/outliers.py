"""Treatment of outliers; quartiles are exact, from ranks that no task holds all values for."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.casts import number
from ..schemas import ColumnPlan, Outlier
from ..sources.scratch import discard
from .ranks import numbers_of, quantiles, ranked

MIN_VALUES = 10


def _bounds(row, p: ColumnPlan) -> tuple[float, float] | None:
    if row is None or row["n"] < MIN_VALUES:
        return None
    if p.outlier == Outlier.CLIP_ZSCORE:
        if not row["s"]:
            return None
        z = p.threshold if p.threshold >= 1.0 else 3.0
        return row["m"] - z * row["s"], row["m"] + z * row["s"]
    low, high = row["q"]
    if high - low <= 0:
        return None
    k = p.threshold if p.threshold > 0 else 1.5
    return low - k * (high - low), high + k * (high - low)


def outlier_bounds(df: DataFrame, plans: dict[str, ColumnPlan]) -> dict[str, tuple[float, float]]:
    """Bounds by column; columns of fewer than MIN_VALUES numbers or without spread have none. A row a column reaches the driver.

    Only columns clipped by quartiles are ranked.
    """
    columns = [c for c in df.columns if c in plans and plans[c].outlier != Outlier.NONE]
    spread = [c for c in columns if plans[c].outlier == Outlier.CLIP_ZSCORE]
    ranks = [c for c in columns if c not in spread]
    rows: dict = {}
    if spread:
        stats = numbers_of(df, spread).groupBy("col_name").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
        rows |= {r["col_name"]: r for r in stats.collect()}
    if ranks:
        table = ranked(numbers_of(df, ranks))
        counts = table.where("x IS NOT NULL").groupBy("col_name").agg(F.sum("n").alias("n"))
        rows |= {r["col_name"]: r for r in counts.join(quantiles(table, [0.25, 0.75]), "col_name").collect()}
        discard(table)
    found = {c: _bounds(rows.get(c), plans[c]) for c in columns}
    return {c: b for c, b in found.items() if b}


def treat_outliers(df: DataFrame, plans: dict[str, ColumnPlan]) -> DataFrame:
    """Clips, sets to null or drops what lies beyond the bounds.

    Columns that drop rows are handled one after another, as each sees the rows that the ones before left; the columns
    between two of them share one pass. Null values never count as outliers.
    """
    run: dict[str, ColumnPlan] = {}
    for c in df.columns:
        if c in plans and plans[c].outlier == Outlier.DROP:
            df, run = _apply(df, run), {}
            df = _apply(df, {c: plans[c]})
        elif c in plans:
            run[c] = plans[c]
    return _apply(df, run)


def _apply(df: DataFrame, plans: dict[str, ColumnPlan]) -> DataFrame:
    bounds = outlier_bounds(df, plans)
    if not bounds:
        return df
    changed, keep = {}, F.lit(True)
    for c, (low, high) in bounds.items():
        x = number(F.col(f"`{c}`"))
        outside = (x < low) | (x > high)
        if plans[c].outlier == Outlier.DROP:
            keep = keep & ~F.coalesce(outside, F.lit(False))
        elif plans[c].outlier == Outlier.SET_NULL:
            changed[c] = F.when(~F.coalesce(outside, F.lit(False)), F.col(f"`{c}`"))
        else:
            changed[c] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
    out = df.where(keep) if any(p.outlier == Outlier.DROP for p in plans.values()) else df
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in df.columns)) if changed else out


def outlier_report(df: DataFrame, plans: dict[str, ColumnPlan]) -> DataFrame:
    """col_name, strategy, outliers, lower_bound and upper_bound of the treated columns."""
    bounds = outlier_bounds(df, plans)
    spark = df.sparkSession
    schema = "col_name string, strategy string, outliers long, lower_bound double, upper_bound double"
    if not bounds:
        return spark.createDataFrame([], schema)
    counted = df.agg(
        *(F.count_if((number(F.col(f"`{c}`")) < low) | (number(F.col(f"`{c}`")) > high)).alias(str(i)) for i, (c, (low, high)) in enumerate(bounds.items()))
    ).first()
    rows = [(c, plans[c].outlier.value, counted[str(i)], round(low, 2), round(high, 2)) for i, (c, (low, high)) in enumerate(bounds.items())]
    return spark.createDataFrame([r for r in rows if r[2]], schema)

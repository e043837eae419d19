"""Cleaning of streams with a plan fitted on a table at rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from ..arrow import on_workers
from ..functions.casts import number
from ..operators.impute import measured, strategy
from ..operators.outliers import outlier_bounds
from ..plans.cleaning import normalize_table
from ..schemas import Impute, Outlier, TablePlan


def fitted_bounds(sample: DataFrame, plan: TablePlan) -> dict[str, tuple[float, float]]:
    """The bounds that a stream's values are clipped to, from a table at rest."""
    return outlier_bounds(normalize_table(sample, plan), plan.columns)


def clean_stream(stream: DataFrame, plan: TablePlan, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Normalized and clipped rows; no state is needed."""
    out = normalize_table(stream, plan)
    for c, (low, high) in (bounds or {}).items():
        x = number(F.col(f"`{c}`"))
        inside = F.least(F.greatest(x, F.lit(low)), F.lit(high))
        outlier = plan.columns[c].outlier
        if outlier == Outlier.DROP:
            out = out.where(x.isNull() | x.between(low, high))
        elif outlier == Outlier.SET_NULL:
            out = out.withColumn(c, F.when(x.isNull() | x.between(low, high), F.col(f"`{c}`")))
        else:
            out = out.withColumn(c, F.when(x.isNotNull(), inside))
    return out


def fitted_fills(sample: DataFrame, plan: TablePlan) -> dict[str, object]:
    """The value that each column's nulls get in a stream, from a table at rest: what impute() would fill there.

    Columns that are filled from their neighbours, dropped rows and columns without a strategy have none.
    """
    plans = {c: p for c, p in plan.columns.items() if c in sample.columns}
    how = {c: strategy(p) for c, p in plans.items()}
    values = measured(normalize_table(sample, plan), plans, how)
    return values | {c: "Unknown" if plans[c].constant is None else plans[c].constant for c in plans if how[c] == Impute.CONSTANT}


def fill_stream(stream: DataFrame, plan: TablePlan, fills: dict[str, object] | None = None) -> DataFrame:
    """Nulls filled with fitted values, and without the rows that a plan drops for a null; no state is needed.

    A value that doesn't fit the column's type fills nothing.
    """
    dtypes = dict(stream.dtypes)
    fit = {c: F.lit(v).try_cast(dtypes[c]) for c, v in (fills or {}).items() if c in dtypes}
    out = stream.select(*(F.coalesce(F.col(f"`{c}`"), fit[c]).alias(c) if c in fit else F.col(f"`{c}`") for c in stream.columns))
    for c, p in plan.columns.items():
        if c in dtypes and strategy(p) == Impute.DROP_ROW:
            out = out.where(F.col(f"`{c}`").isNotNull())
    return out


def _carry(columns: list[str], order: str):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else [None] * len(columns)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable", na_position="first")
        for i, c in enumerate(columns):
            known = rows[c].ffill()
            rows[c] = known if last[i] is None else known.where(known.notna(), last[i])
            value = rows[c].iloc[-1]
            last[i] = None if pd.isna(value) else value.item() if hasattr(value, "item") else value
        state.update(tuple(last))
        yield rows

    return run


def fill_forward(stream: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    """Nulls filled with the last value known of the same keys, in this batch (by ``order``) or before.

    The state is one row for each different keys: their last values. What comes later than rows with a higher ``order``
    is filled from those; so rows that several files hold in no order have to come in one batch. A null before any value
    stays. A batch's rows of one key are sorted together, so the source's limit of files a batch bounds what meets in a
    task. The columns' names mustn't hold dots.
    """
    on_workers(stream.sparkSession)
    state = StructType([StructField(f"v{i}", stream.schema[c].dataType) for i, c in enumerate(columns)])
    return stream.groupBy(*(F.col(f"`{k}`") for k in keys)).applyInPandasWithState(_carry(columns, order), stream.schema, state, "append", GroupStateTimeout.NoTimeout)


def drop_repeats(stream: DataFrame, keys: list[str], event_time: str, delay: str = "10 minutes") -> DataFrame:
    """One row of each key within the delay; the state of older keys is dropped."""
    if dict(stream.dtypes)[event_time] == "timestamp_ntz":
        stream = stream.withColumn(event_time, F.col(f"`{event_time}`").cast("timestamp"))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)

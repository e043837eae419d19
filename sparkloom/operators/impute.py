"""Filling of missing values."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.casts import free_name
from ..plans.cleaning import imputation_for
from ..schemas import WHOLE_TYPES, ColumnPlan, Impute, TablePlan
from ..sources.scratch import cut, discard
from .ranks import modes, numbers_of, quantiles, ranked


def null_share(columns: list[str]) -> Column:
    """The share of a row's values that are null."""
    return sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0)) / F.lit(max(len(columns), 1))


def drop_null_columns(df: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Without the columns of which a larger share is null; one row of shares reaches the driver."""
    row = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(str(i)) for i, c in enumerate(df.columns))).first()
    return df.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if (row[str(i)] or 0) <= threshold))


def drop_null_rows(df: DataFrame, threshold: float = 0.60) -> DataFrame:
    return df.where(null_share(df.columns) <= threshold)


def strategy(p: ColumnPlan) -> Impute:
    return imputation_for(p.type) if p.impute == Impute.AUTO else p.impute


def fill_along(
    df: DataFrame, columns: list[str], order: str, partition: list[str] | None = None, backward: bool = False, ranges: int | None = None
) -> DataFrame:
    """Fills nulls from the last known value before a row, then from the first one after it (or the other way round).

    Rows without ``order`` come first; rows of equal order follow each other in any order. With ``partition`` each of its
    groups (null is one) is filled on its own. A null stays where nothing is known.

    The rows are split into ``ranges`` (as many as the session shuffles to) by group and order, also within a group and
    among rows of equal order, so no group meets in one task. Each range is passed once in either direction. What a range
    needs from others is worked out from the edges of the groups that reach over several: two rows a range at most.
    """
    keys = partition or []
    part, tie = free_name(df, "_range"), free_name(df, "_tie")
    at = [F.col(f"`{order}`").asc_nulls_first(), F.col(tie)]
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *(F.col(f"`{k}`") for k in keys), *at)
    rows = cut(dealt.withColumn(part, F.spark_partition_id()))
    within = Window.partitionBy(part, *(f"`{k}`" for k in keys))
    forth = within.orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    back = within.orderBy(F.col(f"`{order}`").desc_nulls_last(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.select(
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"),
        F.struct(*(F.last(f"`{c}`", True).over(forth).alias(f"p{i}") for i, c in enumerate(columns))).alias("_before"),
        F.struct(*(F.last(f"`{c}`", True).over(back).alias(f"n{i}") for i, c in enumerate(columns))).alias("_after"),
    )

    def place(c: str) -> Column:
        # Rows without order come before all others.
        return F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.col(f"`{order}`").isNotNull().alias("known"), F.col(f"`{order}`").alias("at"), F.col(tie).alias("tie")))

    edges = rows.groupBy(F.col(part).alias("_part"), *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys))).agg(
        *(a for i, c in enumerate(columns) for a in (F.max_by(f"`{c}`", place(c)).alias(f"_l{i}"), F.min_by(f"`{c}`", place(c)).alias(f"_f{i}")))
    )
    group = Window.partitionBy(*(f"_k{i}" for i in range(len(keys))))
    earlier, later = (group.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_part"), F.desc("_part")))
    carried = edges.select(
        F.struct("_part", *(f"_k{i}" for i in range(len(keys)))).alias("_at"),
        F.struct(*(F.last(f"_l{i}", True).over(earlier).alias(f"b{i}") for i in range(len(columns)))).alias("_back"),
        F.struct(*(F.last(f"_f{i}", True).over(later).alias(f"a{i}") for i in range(len(columns)))).alias("_forth"),
        F.count(F.lit(1)).over(group).alias("_reach"),
    ).where(F.col("_reach") > 1)
    meets = F.col("_row")[part] == F.col("_at")["_part"]
    for i, k in enumerate(keys):
        meets = meets & F.col("_row")[k].eqNullSafe(F.col("_at")[f"_k{i}"])
    joined = near.join(F.broadcast(carried), meets, "left")  # two rows a range at most: a group reaches over a border or not
    filled = {}
    for i, c in enumerate(columns):
        prev, nxt = F.coalesce(F.col("_before")[f"p{i}"], F.col("_back")[f"b{i}"]), F.coalesce(F.col("_after")[f"n{i}"], F.col("_forth")[f"a{i}"])
        filled[c] = F.coalesce(nxt, prev) if backward else F.coalesce(prev, nxt)
    return joined.select(*((filled[c] if c in columns else F.col("_row")[c]).alias(c) for c in df.columns))


def impute(df: DataFrame, plan: TablePlan, order: str | None = None) -> DataFrame:
    """Fills each column by its strategy (columns without a plan are AUTO of an unknown type, so constant).

    Rows dropped for one column are gone for the later ones, so
    the columns before and after a dropping one are handled in turn. Forward and backward filling needs ``order``.
    """
    plans = {c: plan.columns.get(c, ColumnPlan()) for c in df.columns if c != order}
    run: dict[str, ColumnPlan] = {}
    for c, p in plans.items():
        if strategy(p) == Impute.DROP_ROW:
            df, run = _fill(df, run, order), {}
            df = df.where(F.col(f"`{c}`").isNotNull())
        else:
            run[c] = p
    return _fill(df, run, order)


def measured(df: DataFrame, plans: dict[str, ColumnPlan], how: dict[str, Impute]) -> dict[str, object]:
    """The mean, median or mode of each column that needs one; columns without numbers have none."""
    of = lambda kind: [c for c in plans if how[c] == kind]
    values: dict[str, object] = {c: "Unknown" if v is None else v for c, v in modes(df, of(Impute.MODE)).items()}
    if means := of(Impute.MEAN):
        row = numbers_of(df, means).groupBy("col_name").agg(F.avg("x").alias("x")).collect()
        values |= {r["col_name"]: round(r["x"], 2) for r in row if r["x"] is not None}
    if medians := of(Impute.MEDIAN):
        table = ranked(numbers_of(df, medians))
        for r in quantiles(table, [0.5]).collect():  # a row a column
            whole = plans[r["col_name"]].type in WHOLE_TYPES
            values[r["col_name"]] = int(round(r["q"][0])) if whole else round(r["q"][0], 2)
        discard(table)
    return values


def _fill(df: DataFrame, plans: dict[str, ColumnPlan], order: str | None) -> DataFrame:
    how = {c: strategy(p) for c, p in plans.items()}
    values: dict[str, object] = measured(df, plans, how)
    for c in plans:
        if how[c] == Impute.CONSTANT:
            values[c] = "Unknown" if plans[c].constant is None else plans[c].constant
    dtypes = dict(df.dtypes)

    def fill(c: str) -> Column:
        fits = F.lit(values[c]).try_cast(dtypes[c])
        return F.coalesce(F.col(f"`{c}`"), fits).alias(c)

    out = df.select(*(fill(c) if c in values else F.col(f"`{c}`") for c in df.columns))
    for kind, backward in ((Impute.FORWARD_FILL, False), (Impute.BACKWARD_FILL, True)):
        columns = [c for c in plans if how[c] == kind]
        if columns:
            if order is None:
                raise ValueError("forward and backward filling needs the name of a column that orders the rows")
            out = fill_along(out, columns, order, backward=backward)
    return out


def impute_report(df: DataFrame, plan: TablePlan, order: str | None = None) -> DataFrame:
    """col_name, strategy, nulls_before, nulls_handled and imputed_value (a text) of each column, before rows are dropped."""
    columns = [c for c in df.columns if c != order]
    plans = {c: plan.columns.get(c, ColumnPlan()) for c in columns}
    how = {c: strategy(p) for c, p in plans.items()}
    values = measured(df, plans, how)
    values |= {c: "Unknown" if plans[c].constant is None else plans[c].constant for c in columns if how[c] == Impute.CONSTANT}
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(columns))).first()
    dtypes, out = dict(df.dtypes), []
    for i, c in enumerate(columns):
        nulls = row["n"] - row[str(i)]
        if c in values:
            fits = df.sparkSession.range(1).select(F.lit(values[c]).try_cast(dtypes[c]).isNotNull()).first()[0]
        else:
            fits = how[c] in (Impute.FORWARD_FILL, Impute.BACKWARD_FILL) and row[str(i)] > 0
        done = nulls if fits or how[c] == Impute.DROP_ROW else 0
        out.append((c, how[c].value if nulls else Impute.NONE.value, nulls, done, str(values[c]) if c in values and nulls else None))
    return df.sparkSession.createDataFrame(out, "col_name string, strategy string, nulls_before long, nulls_handled long, imputed_value string")

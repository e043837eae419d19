"""From a source to a clean, validated and indexed table."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .functions.casts import number
from .operators.dedup import drop_exact, drop_similar
from .operators.impute import drop_null_columns, drop_null_rows, impute
from .operators.outliers import treat_outliers
from .operators.profile import detected_types, profile
from .operators.validate import passed, validate
from .plans.cleaning import default_plan, normalize_table
from .schemas import WHOLE_TYPES, TablePlan
from .schemas import SemanticType as T
from .sources.readers import extract, with_row_id
from .sources.scratch import cut
from .sources.sinks import Index

ROW_ID = "_row_id"


def clean(df: DataFrame, plan: TablePlan, order: str = ROW_ID) -> DataFrame:
    """Normalizes, treats outliers, fills, removes duplicates; whole-number types end as bigint.

    The order matters: medians see clipped values, and duplicates are judged on filled ones.
    """
    out = treat_outliers(normalize_table(df, plan), plan.columns)
    columns = [c for c in out.columns if c != order]
    if plan.drop_null_columns:
        kept = drop_null_columns(out.select(*(f"`{c}`" for c in columns)), plan.null_column_threshold).columns
        out = out.select(*(f"`{c}`" for c in kept), order)
    if plan.drop_null_rows:
        out = drop_null_rows(out, plan.null_row_threshold)
    out = impute(out, plan, order)
    if plan.drop_exact_duplicates:
        out = drop_exact(out, order)
    if plan.fuzzy_keys:
        out = drop_similar(out, [k for k in plan.fuzzy_keys if k in out.columns], order, plan.fuzzy_threshold)
    whole = {c for c, p in plan.columns.items() if p.type in WHOLE_TYPES}
    return out.select(*(number(out[f"`{c}`"]).try_cast("bigint").alias(c) if c in whole else out[f"`{c}`"] for c in out.columns))


@dataclass
class Result:
    success: bool
    stage: str
    seconds: float
    rows_in: int = 0
    rows_out: int = 0
    indexed: int = 0
    failed: int = 0
    validation_passed: bool = False
    types: dict[str, T] = field(default_factory=dict)
    profile: DataFrame | None = None
    cleaned: DataFrame | None = None
    report: DataFrame | None = None
    message: str = ""


def run(spark: SparkSession, path: str, index: str | None = None, plan: TablePlan | None = None, hint: str | None = None, **options) -> Result:
    """Reads, profiles, plans (unless a plan is given), cleans, validates and, with ``index``, writes the documents.

    The cleaned rows are a table in the shared folder. A failure of the source, of Spark or of a value is told in the result,
    with the stage that it came from.
    """
    began, stage = time.time(), "extract"
    try:
        rows = with_row_id(extract(spark, path, hint, **options), ROW_ID)
        rows_in = rows.count()
        stage = "profile"
        profiled = profile(rows.drop(ROW_ID))
        types = detected_types(profiled)
        stage = "clean"
        plan = plan or default_plan(types)
        cleaned = cut(clean(rows, plan))
        rows_out = cleaned.count()
        stage = "validate"
        report = validate(cleaned.drop(ROW_ID), {c: p.type for c, p in plan.columns.items()})
        stage = "load"
        done = Index(spark, index).load(cleaned, types, ROW_ID) if index else None
        written = (done.indexed, done.failed, passed(report), types, profiled, cleaned, report, done.message) if done else (0, 0, passed(report), types, profiled, cleaned, report, "")
        return Result(True, "done", time.time() - began, rows_in, rows_out, *written)
    except (PySparkException, Py4JError, ValueError, RuntimeError, OSError) as e:
        return Result(False, stage, time.time() - began, message=str(e))

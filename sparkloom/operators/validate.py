"""Quality rules by semantic type."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..arrow import on_workers
from ..functions.casts import number, strip
from ..functions.dates import parse_any
from ..functions.predicates import is_datetime, is_email
from ..schemas import CLOCK_TYPES, DATE_TYPES
from ..schemas import SemanticType as T

PASSED_FROM = 0.80
REPORT = "col_name string, semantic_type string, validation_type string, compliance_rate double, valid_count long, invalid_count long, null_count long"


def rule(t: T, c: Column) -> tuple[str, Column]:
    """The name of the rule and whether a known value keeps it."""
    s = c.cast("string")
    if t == T.PHONE_PAKISTAN:
        ok = (s.startswith("923") & (F.length(s) == 12)) | (s.startswith("+923") & (F.length(s) == 13)) | (s.startswith("03") & (F.length(s) == 11))
        return "Pakistani mobile number", ok
    if t == T.EMAIL:
        return "E-mail address", is_email(s)
    if t == T.CNIC_PAKISTAN:
        return "CNIC in three groups", s.rlike("(?s)^.{5}-.{7}-.$")
    if t in DATE_TYPES:
        return "Date or time that parses", is_datetime(s)
    if t in CLOCK_TYPES:
        return "Clock digits with colons", strip(s).rlike("^[0-9]+:[0-9]{2}(?::[0-9]{2})?$")
    if t == T.AGE:
        return "Age from 0 to 120", F.coalesce(number(s).between(0, 120), F.lit(False))
    if t in (T.NUMERIC_FLOAT, T.CURRENCY_AMOUNT):
        return "Number", number(s).isNotNull()
    return "Any value", F.lit(True)


def _other_dates(df: DataFrame, column: str) -> int:
    """How many values hold a whole date in a layout that is_datetime doesn't know; each distinct value is parsed once."""
    on_workers(df.sparkSession)
    value = F.col(f"`{column}`").cast("string").alias("value")
    freq = df.select(value).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    freq = freq.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value")  # not one task for short values
    freq = freq.where(~F.coalesce(is_datetime(F.col("value")), F.lit(True)))
    return freq.where(parse_any(F.col("value")).isNotNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def validate(df: DataFrame, types: dict[str, T], any_layout: bool = False) -> DataFrame:
    """One row per column (REPORT), all from one aggregate. A column of nulls alone counts all of its rows as invalid.

    With ``any_layout`` a parser reads the dates that are in none of the layouts, in a pass for each column of dates.
    """
    names = df.columns
    rules = {c: rule(types.get(c, T.UNKNOWN), F.col(f"`{c}`")) for c in names}
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)),
        *(F.count_if(F.col(f"`{c}`").isNotNull() & rules[c][1]).alias(f"v{i}") for i, c in enumerate(names)),
    ).first()
    out = []
    for i, c in enumerate(names):
        n, known, valid = row["n"], row[f"k{i}"], row[f"v{i}"]
        if any_layout and types.get(c) in DATE_TYPES and valid < known:
            valid += _other_dates(df, c)
        t = types.get(c, T.UNKNOWN).value
        if known:
            out.append((c, t, rules[c][0], round(100 * valid / known, 2), valid, known - valid, n - known))
        else:
            out.append((c, t, "all_null", 0.0, 0, n, n))
    return df.sparkSession.createDataFrame(out, REPORT)


def passed(report: DataFrame) -> bool:
    """Whether PASSED_FROM of all checks hold; a column of nulls alone is one failed check."""
    checks = F.when(F.col("validation_type") == "all_null", 1).otherwise(F.col("valid_count") + F.col("invalid_count"))
    row = report.agg(F.sum("valid_count").alias("v"), F.sum(checks).alias("n")).first()
    return not row["n"] or row["v"] / row["n"] >= PASSED_FROM


def anomalies(report: DataFrame) -> DataFrame:
    """A message for each column with values that break its rule."""
    said = F.concat("col_name", F.lit(": "), F.col("invalid_count").cast("string"), F.lit(" values are against the rule: "), "validation_type")
    return report.where("invalid_count > 0 AND validation_type <> 'all_null'").select(said.alias("anomaly"))

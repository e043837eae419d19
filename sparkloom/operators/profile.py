"""Profiles of all columns from one table of value frequencies.

The columns are unpivoted and counted once, with partial counts before the shuffle. Nulls, distinct values, frequent values
and kinds then come from distinct values weighted by their counts; percentiles are exact, from ranges of ranks.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.types import NumericType, StringType

from ..arrow import on_workers
from ..functions.casts import number, text
from ..functions.dates import parse_any
from ..functions.predicates import kind
from ..plans.fuse import Evidence, decide
from ..plans.names import match_name
from ..schemas import SemanticType as T
from ..sources.scratch import cut, discard
from .ranks import numbers_of, quantiles, ranked


def value_frequencies(df: DataFrame) -> DataFrame:
    """col_name, value (as text, null for nulls) and count, over all rows."""
    dtypes = dict(df.dtypes)
    wide = df.select(*(text(F.col(f"`{c}`"), dtypes[c]).alias(c) if not dtypes[c].startswith(("array", "map", "struct")) else F.to_json(f"`{c}`").alias(c) for c in df.columns))
    long = wide.unpivot([], [F.col(f"`{c}`") for c in df.columns], "col_name", "value")
    return long.groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("count"))


def counts_by_column(freq: DataFrame) -> DataFrame:
    """col_name, total_count, null_count, null_percentage, unique_count."""
    nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0))
    found = freq.groupBy("col_name").agg(
        F.sum("count").alias("total_count"), nulls.alias("null_count"), F.count("value").alias("unique_count")
    )
    return found.select("col_name", "total_count", "null_count", F.round(F.col("null_count") / F.col("total_count"), 4).alias("null_percentage"), "unique_count")


def top_values(freq: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent values of each column (ties: smaller text first) with their rank."""
    order = Window.partitionBy("col_name").orderBy(F.desc("count"), "value")
    return freq.where("value IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def kinds(freq: DataFrame, any_layout: bool = False) -> DataFrame:
    """col_name, kind and its share of the values that aren't blank. Each distinct value is tested once.

    With ``any_layout`` a parser reads the values that pass no test: those with a whole date in them are datetimes, too.
    """
    found = kind(F.col("value"))
    if any_layout:
        on_workers(freq.sparkSession)
        # In as many parts as the session shuffles to: values are short, and adaptive execution would test them all in one task.
        parts = int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        freq = cut(freq.repartition(parts, "col_name", "value").withColumn("_kind", found))
        other = F.col("_kind") == "other"
        found = F.when(other & parse_any(F.when(other, F.col("value"))).isNotNull(), "datetime").otherwise(F.col("_kind"))
    each = freq.withColumn("kind", found).where("kind IS NOT NULL").groupBy("col_name", "kind").agg(F.sum("count").alias("count"))
    return each.withColumn("ratio", F.col("count") / F.sum("count").over(Window.partitionBy("col_name")))


def recovered_number(c: Column) -> Column:
    """The number in a text without $ , P K R s and white space, each single character of that set removed."""
    return number(F.regexp_replace(c, r"[$,PKRs\s]", ""))


def numeric_stats(values: DataFrame, text_columns: list[str]) -> DataFrame:
    """Minimum, maximum, mean, median, standard deviation and outliers beyond 1.5 interquartile ranges of (col_name, x, n).

    Text columns count as numeric if over half of their values give a number; ``x`` is null for the others.
    """
    is_text = F.col("col_name").isin(text_columns) if text_columns else F.lit(False)
    table = ranked(values)
    n, x = F.col("n"), F.col("x")
    weight = F.when(x.isNotNull(), n)
    stats = table.groupBy("col_name").agg(
        F.sum(weight).alias("numbers"), F.sum("n").alias("known"), F.min("x").alias("min_value"), F.max("x").alias("max_value"), (F.sum(x * n) / F.sum(weight)).alias("mean")
    )
    stats = stats.where((F.col("numbers") > 0) & (~is_text | (F.col("numbers") > 0.5 * F.col("known")))).join(F.broadcast(quantiles(table, [0.25, 0.5, 0.75])), "col_name")
    stats = F.broadcast(stats)  # one row a column
    low = F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0])
    high = F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])
    outside = ((x < low) | (x > high)) & (F.col("q")[2] > F.col("q")[0])
    more = table.where("x IS NOT NULL").join(stats, "col_name").groupBy("col_name", "numbers", "min_value", "max_value", "mean", "q").agg(
        F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))).alias("squares"), F.coalesce(F.sum(F.when(outside, n)), F.lit(0)).alias("outlier_count")
    )
    spread = F.when(F.col("numbers") > 1, F.sqrt(F.col("squares") / (F.col("numbers") - 1))).otherwise(0.0)
    return more.select(
        "col_name", "min_value", "max_value", F.round("mean", 2).alias("mean_value"), F.round(F.col("q")[1], 2).alias("median_value"), F.round(spread, 2).alias("std_dev"), "outlier_count"
    )


def numeric_values(df: DataFrame, freq: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(col_name, x, n) of the numeric columns as they are and of text columns by recovered_number, and the names of the latter."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    found = numbers_of(df, numeric).where("x IS NOT NULL") if numeric else None
    if texts:
        freq = value_frequencies(df.select(*(f"`{c}`" for c in texts))) if freq is None else freq
        of_text = freq.where(F.col("value").isNotNull() & F.col("col_name").isin(texts)).select("col_name", recovered_number(F.col("value")).alias("x"), F.col("count").alias("n"))
        found = of_text if found is None else found.unionByName(of_text)
    if found is None:
        found = df.sparkSession.createDataFrame([], "col_name string, x double, n long")
    return found, texts


PROFILE = (
    "col_name string, original_dtype string, detected_type string, confidence_score double, detected_format string, total_count long, "
    "null_count long, null_percentage double, unique_count long, sample_values array<string>, top_values array<struct<value:string,count:long>>, "
    "min_value double, max_value double, mean_value double, median_value double, std_dev double, outlier_count long, regex_match_rate double, "
    "col_name_similarity double, notes array<string>"
)


def profile(df: DataFrame, name_mode: str = "levenshtein", synonyms: dict[T, tuple[str, ...]] | None = None, any_layout: bool = False) -> DataFrame:
    """One row per column (PROFILE). Only statistics, a few rows a column, reach the driver, which fuses the evidence.

    ``synonyms`` is an ontology of column names for match_name, in place of the built-in one; ``any_layout`` is that of kinds().
    """
    spark = df.sparkSession
    freq = cut(value_frequencies(df))
    try:
        counts = {r["col_name"]: r for r in counts_by_column(freq).collect()}
        stats = {r["col_name"]: r for r in numeric_stats(*numeric_values(df, freq)).collect()}
        top: dict[str, list] = {}
        for r in sorted(top_values(freq).collect(), key=lambda r: r["rank"]):
            top.setdefault(r["col_name"], []).append((r["value"], r["count"]))
        ratios: dict[str, dict[T, float]] = {}
        for r in kinds(freq, any_layout).collect():
            if r["kind"] != "other":
                ratios.setdefault(r["col_name"], {})[T(r["kind"])] = r["ratio"]
        lengths = {r["col_name"]: r["mean"] for r in freq.where("value IS NOT NULL").groupBy("col_name").agg((F.sum(F.length("value") * F.col("count")) / F.sum("count")).alias("mean")).collect()}
    finally:
        discard(freq)
    rows = []
    for f in df.schema.fields:
        c, s, share = counts.get(f.name), stats.get(f.name), ratios.get(f.name, {})
        total, nulls, distinct = (c["total_count"], c["null_count"], c["unique_count"]) if c else (0, 0, 0)
        if T.DURATION in share:
            share[T.TIME] = share[T.DURATION]
        named, score = match_name(f.name, synonyms, name_mode)[0]
        is_text = isinstance(f.dataType, StringType) and total > nulls
        low, high = (s["min_value"], s["max_value"]) if s else (None, None)
        found, confidence, layout = decide(Evidence(share, named, score, is_text, distinct, total, low, high, lengths.get(f.name) or 0.0))
        values = top.get(f.name, [])
        rows.append(
            (
                f.name, f.dataType.simpleString(), found.value, round(confidence, 3), layout, total, nulls, round(nulls / total, 4) if total else 0.0, distinct,
                [v for v, _ in values], values, low, high, *((s["mean_value"], s["median_value"], s["std_dev"], s["outlier_count"]) if s else (None, None, None, 0)),
                round(share.get(found, 0.0), 3), round(score, 3), [f"name suggests {named.value}"] if score > 0.40 else [],
            )
        )
    return spark.createDataFrame(rows, PROFILE)


def detected_types(profiled: DataFrame) -> dict[str, T]:
    return {r["col_name"]: T(r["detected_type"]) for r in profiled.select("col_name", "detected_type").collect()}


def size_in_bytes(df: DataFrame) -> int:
    """The bytes that Spark's planner expects of a table, from files and statistics; nothing is computed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dataset_summary(df: DataFrame) -> DataFrame:
    """row_count, col_count and duplicate_rows (rows equal to another, but for one of each)."""
    counted = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")).withColumn(
        "col_count", F.lit(len(df.columns)).cast("long")
    )


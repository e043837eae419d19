"""Substring search over all fields of a table."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.casts import text

TERM_CLAUSES = ("multi_match", "match", "query_string")


def term_of(query: dict | None, strict: bool = False) -> str:
    """The term that a query asks for; empty (which matches all) for match_all, no query and clauses without support.

    With ``strict`` such clauses raise an error.
    """
    clause = (query or {}).get("query", query or {})
    if not clause or "match_all" in clause:
        return ""
    for name in TERM_CLAUSES:
        if name in clause:
            body = clause[name]
            if name != "match":
                return str(body.get("query", ""))
            value = next(iter(body.values()), "") if isinstance(body, dict) else body
            return str(value.get("query", "") if isinstance(value, dict) else value)
    if strict:
        raise ValueError(f"unsupported clause: {', '.join(clause)}")
    return ""


def matches(df: DataFrame, term: str) -> Column:
    """How many fields hold the term, whatever its case."""
    dtypes = dict(df.dtypes)
    fields = [F.lower(text(F.col(f"`{c}`"), dtypes[c])) for c in df.columns]
    return sum((F.coalesce(F.contains(f, F.lit(term.lower())), F.lit(False)).cast("int") for f in fields), F.lit(0))


def search(df: DataFrame, query: dict | None = None, strict: bool = False) -> DataFrame:
    """The rows that match with ``_score``; all with score 1 for an empty term."""
    term = term_of(query, strict)
    if not term:
        return df.withColumn("_score", F.lit(1.0))
    return df.withColumn("_score", matches(df, term).cast("double")).where("_score > 0")


def page(hits: DataFrame, order: str, size: int = 50, start: int = 0) -> DataFrame:
    return hits.orderBy(order).offset(start).limit(size)


def search_many(tables: dict[str, DataFrame], query: dict | None = None, index: str | None = None) -> DataFrame:
    """Hits of one index, or of all if it isn't known, as _index, _score and _source (JSON)."""
    chosen = {index: tables[index]} if index in tables else tables
    out = None
    for name, df in chosen.items():
        hits = search(df, query).select(F.lit(name).alias("_index"), F.lit(1.0).alias("_score"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("_source"))
        out = hits if out is None else out.unionByName(hits)
    return out

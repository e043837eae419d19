"""Casts between text and numbers with one meaning on every input type."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"
# Texts that stand for a missing value.
NULL_TOKENS = ("nan", "none", "null", "n/a")
# Texts that readers take for a missing value.
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def strip(c: Column) -> Column:
    """Without white space at either end, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def bind(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it; keeps the generated code of long rules small."""
    return F.transform(F.array(c), fn)[0]


def known(c: Column) -> Column:
    """Stripped text; null for blank text and for the tokens that stand for a missing value."""
    s = strip(c.cast("string"))
    return F.when((s == "") | F.lower(s).isin(*NULL_TOKENS), None).otherwise(s)


def number(c: Column) -> Column:
    """A double, or null where the text is no plain number (inf, NaN and suffixes like 1d are none)."""
    s = c.cast("string")
    return F.when(s.rlike(NUMBER), strip(s).try_cast("double"))


def text(c: Column, dtype: str) -> Column:
    """The text of a value; doubles from 1e7 to 1e16 and below 1e-3 in plain digits rather than in exponent form."""
    if dtype in ("double", "float"):
        plain = F.regexp_replace(c.cast("string").try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?[1-9]|\.0)0*$", "$1")
        size = F.abs(c)
        return F.when(((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)), plain).otherwise(c.cast("string"))
    if dtype == "boolean":
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def na_to_null(c: Column) -> Column:
    return F.when(c.isin(*NA_VALUES), None).otherwise(c)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

"""The default plan for a profile, and the compilation of a plan to Columns."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions import normalize as N
from ..functions.casts import number
from ..schemas import CLOCK_TYPES, DATE_TYPES, MODE_TYPES, NUMERIC_TYPES, ColumnPlan, Impute, Outlier, TablePlan
from ..schemas import SemanticType as T


def imputation_for(t: T) -> Impute:
    """The strategy that AUTO stands for."""
    if t in NUMERIC_TYPES:
        return Impute.MEDIAN
    if t in MODE_TYPES:
        return Impute.MODE
    return Impute.FORWARD_FILL if t in DATE_TYPES else Impute.CONSTANT


def default_plan(types: dict[str, T]) -> TablePlan:
    def column(t: T) -> ColumnPlan:
        how = imputation_for(t)
        return ColumnPlan(t, how, "Unknown" if how == Impute.CONSTANT else None, Outlier.CLIP_IQR if t in NUMERIC_TYPES else Outlier.NONE)

    return TablePlan({c: column(t) for c, t in types.items()})


def normalized(c: Column, p: ColumnPlan) -> Column:
    """Cleaned text, then the type's own normalizer."""
    s = N.clean_text(c, p.casing, p.strip)
    if p.type == T.PHONE_PAKISTAN:
        return N.clean_phone(s, p.phone_prefix)
    if p.type == T.PHONE_INTERNATIONAL:
        return N.clean_intl_phone(s)
    if p.type == T.CNIC_PAKISTAN:
        return N.clean_cnic(s)
    if p.type in DATE_TYPES:
        return N.clean_datetime(s, p.datetime_format)
    if p.type in CLOCK_TYPES:
        return N.clean_duration(s, p.duration_format)
    if p.type == T.CURRENCY_AMOUNT:
        return N.clean_currency(s)
    if p.type == T.BOOLEAN:
        return N.clean_boolean(s)
    if p.type in (T.NUMERIC_FLOAT, T.NUMERIC_INTEGER, T.AGE):
        return number(s)
    return s


def normalize_table(df: DataFrame, plan: TablePlan) -> DataFrame:
    """One projection; columns that the plan doesn't name keep their values."""
    return df.select(*(normalized(F.col(f"`{c}`"), plan.columns[c]).alias(c) if c in plan.columns else F.col(f"`{c}`") for c in df.columns))


# The index fields of the types; all others are text with a keyword beside it.
_DATE = {"type": "date", "format": "strict_date_optional_time||yyyy-MM-dd HH:mm:ss||yyyy-MM-dd||epoch_millis"}
_KEYWORD_TEXT = {"type": "text", "fields": {"keyword": {"type": "keyword", "ignore_above": 256}}}
INDEX_FIELDS: dict[T, dict] = {
    T.DATETIME: _DATE,
    T.DATE: _DATE,
    T.NUMERIC_INTEGER: {"type": "long"},
    T.AGE: {"type": "long"},
    T.IDENTIFIER_ID: {"type": "long"},
    T.YEAR: {"type": "long"},
    T.NUMERIC_FLOAT: {"type": "double"},
    T.CURRENCY_AMOUNT: {"type": "double"},
    T.PERCENTAGE: {"type": "double"},
    T.BOOLEAN: {"type": "boolean"},
    T.IP_ADDRESS: {"type": "ip"},
    T.TEXT_LONG: {"type": "text", "analyzer": "standard"},
    T.CATEGORICAL: {"type": "keyword"},
    T.GENDER: {"type": "keyword"},
    T.CITY: {"type": "keyword"},
    T.COUNTRY: {"type": "keyword"},
    T.POSTAL_CODE: {"type": "keyword"},
    T.DURATION: {"type": "keyword"},
    T.TIME: {"type": "keyword"},
}


def index_type(t: T) -> dict:
    """The index field of a type."""
    return INDEX_FIELDS.get(t, _KEYWORD_TEXT)


def index_mapping(types: dict[str, T]) -> dict:
    settings = {"number_of_shards": 1, "number_of_replicas": 0, "analysis": {"analyzer": {"default": {"type": "standard"}}}}
    return {"settings": settings, "mappings": {"properties": {c: index_type(t) for c, t in types.items()}}}

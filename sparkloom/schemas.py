"""Semantic types, strategies and the configurations that plans are compiled from."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class SemanticType(str, Enum):
    # The names of the semantic types.
    PHONE_PAKISTAN = "phone_pakistan"
    PHONE_INTERNATIONAL = "phone_international"
    EMAIL = "email"
    CNIC_PAKISTAN = "cnic_pakistan"
    NAME_PERSON = "name_person"
    AGE = "age"
    GENDER = "gender"
    ADDRESS = "address"
    CITY = "city"
    COUNTRY = "country"
    POSTAL_CODE = "postal_code"
    DATETIME = "datetime"
    DATE = "date"
    TIME = "time"
    DURATION = "duration"
    YEAR = "year"
    TIMESTAMP_EPOCH = "timestamp_epoch"
    CURRENCY_AMOUNT = "currency_amount"
    PERCENTAGE = "percentage"
    NUMERIC_INTEGER = "numeric_integer"
    NUMERIC_FLOAT = "numeric_float"
    IDENTIFIER_ID = "identifier_id"
    URL = "url"
    IP_ADDRESS = "ip_address"
    MAC_ADDRESS = "mac_address"
    BOOLEAN = "boolean"
    CATEGORICAL = "categorical"
    TEXT_LONG = "text_long"
    TEXT_GENERIC = "text_generic"
    JSON_EMBEDDED = "json_embedded"
    UNKNOWN = "unknown"


class Impute(str, Enum):
    # The names of the strategies.
    AUTO = "auto"
    MEAN = "mean"
    MEDIAN = "median"
    MODE = "mode"
    FORWARD_FILL = "ffill"
    BACKWARD_FILL = "bfill"
    CONSTANT = "constant"
    DROP_ROW = "drop_row"
    NONE = "none"


class Outlier(str, Enum):
    # The names of the treatments.
    NONE = "none"
    CLIP_IQR = "clip_iqr"
    CLIP_ZSCORE = "clip_zscore"
    DROP = "drop"
    SET_NULL = "set_null"


T = SemanticType
NUMERIC_TYPES = frozenset({T.NUMERIC_FLOAT, T.CURRENCY_AMOUNT, T.PERCENTAGE, T.NUMERIC_INTEGER, T.AGE})
WHOLE_TYPES = frozenset({T.NUMERIC_INTEGER, T.AGE})
MODE_TYPES = frozenset({T.CATEGORICAL, T.GENDER, T.BOOLEAN, T.CITY, T.COUNTRY})
DATE_TYPES = frozenset({T.DATETIME, T.DATE})
CLOCK_TYPES = frozenset({T.DURATION, T.TIME})


@dataclass(frozen=True)
class ColumnPlan:
    """What to do with one column."""

    type: SemanticType = T.UNKNOWN
    impute: Impute = Impute.AUTO
    constant: object = None
    outlier: Outlier = Outlier.NONE
    threshold: float = 1.5
    phone_prefix: str = "92"
    datetime_format: str = "yyyy-MM-dd HH:mm:ss"
    duration_format: str = "H:MM:SS"
    casing: str | None = None
    strip: bool = True


@dataclass(frozen=True)
class TablePlan:
    """What to do with a table; columns by name."""

    columns: dict[str, ColumnPlan] = field(default_factory=dict)
    drop_exact_duplicates: bool = True
    fuzzy_keys: tuple[str, ...] = ()
    fuzzy_threshold: float = 0.85
    drop_null_columns: bool = False
    null_column_threshold: float = 0.80
    drop_null_rows: bool = False
    null_row_threshold: float = 0.60

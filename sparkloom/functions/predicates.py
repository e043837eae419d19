"""Tests of single values, each a Column, and the first one that a value passes."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from .casts import bind, number, strip
from .dates import parse_datetime

# Patterns and word sets.
PK_PHONE = r"^(?:\+92|0092|92|0)?[- ]?(3[0-9]{2})[- ]?([0-9]{7})$"
INTL_PHONE = r"^\+(?:[0-9] ?){6,14}[0-9]$"
CNIC = r"^[0-9]{5}[- ]?[0-9]{7}[- ]?[0-9]$"
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$"
PERCENT = r"^[-+]?[0-9]+(?:\.[0-9]+)?\s*%$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
IPV6 = r"(?i)^(?:[A-F0-9]{1,4}:){7}[A-F0-9]{1,4}$"
URL = r"(?i)^(?:https?://|ftp://|www\.)[^\s/$.?#].[^\s]*$"
CLOCK_12 = r"(?i)^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*[ap]m$"
CLOCK_24 = r"^[0-9]{1,3}:[0-9]{2}(?::[0-9]{2})?$"
DURATION_WORDS = r"(?i)^(?:[0-9]+\s*(?:h|hr|hrs|hours?|m|min|mins|minutes?|s|sec|secs|seconds?)\s*)+$"
ADDRESS_WORDS = r"(?i)\b(street|st|road|rd|avenue|ave|lane|ln|sector|block|phase|house|h#|flat|apt|plot|mohallah|colony|dha|bahria)\b"
CURRENCY_MARKS = r"[$€£¥₹]|PKR|Rs|pkr|rs"
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "1", "0", "t", "f", "active", "inactive", "pass", "fail")
GENDERS = ("male", "female", "m", "f", "other", "non-binary", "mard", "aurat", "transgender")


def is_pk_phone(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s()-]", "").rlike(PK_PHONE)


def is_intl_phone(c: Column) -> Column:
    return strip(c).rlike(INTL_PHONE)


def is_cnic(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s-]", "").rlike("^[0-9]{13}$") | strip(c).rlike(CNIC)


def is_email(c: Column) -> Column:
    return strip(c).rlike(EMAIL)


def is_clock(c: Column) -> Column:
    """A time of day or a duration; never a text with - or /."""
    s = strip(c)
    return ~s.rlike("[-/]") & (s.rlike(CLOCK_12) | s.rlike(CLOCK_24) | s.rlike(DURATION_WORDS))


def is_datetime(c: Column) -> Column:
    """Epoch seconds or milliseconds, or a date in one of the known layouts."""
    s = strip(c)
    return s.rlike("^([0-9]{10}|[0-9]{13})$") | ((F.length(s) >= 5) & s.rlike("[-/:T ]") & ~s.rlike("^[0-9]+$") & parse_datetime(s).isNotNull())


def is_currency(c: Column) -> Column:
    s = strip(c)
    return s.rlike(CURRENCY_MARKS) & number(F.regexp_replace(s, r"[^0-9.-]", "")).isNotNull()


def is_percent(c: Column) -> Column:
    return strip(c).rlike(PERCENT)


def is_ip(c: Column) -> Column:
    return strip(c).rlike(IPV4) | strip(c).rlike(IPV6)


def is_url(c: Column) -> Column:
    return strip(c).rlike(URL)


def is_age(c: Column) -> Column:
    v = number(c)
    return F.coalesce((v == F.floor(v)) & v.between(0, 120), F.lit(False))


def is_address(c: Column) -> Column:
    s = strip(c)
    return (F.length(s) > 10) & s.rlike(ADDRESS_WORDS)


def is_blank(c: Column) -> Column:
    s = strip(c)
    return c.isNull() | (s == "") | F.lower(c).isin("nan", "null")


def kind(c: Column) -> Column:
    """The first test that a value passes; ``other`` if none, null for blank values. Clock values count as duration and time."""
    return F.when(~is_blank(c), bind(strip(c), _kind))


def _kind(s: Column) -> Column:
    tests = (
        ("phone_pakistan", is_pk_phone(s)),
        ("cnic_pakistan", is_cnic(s)),
        ("phone_international", is_intl_phone(s)),
        ("email", is_email(s)),
        ("duration", is_clock(s)),
        ("datetime", is_datetime(s)),
        ("currency_amount", is_currency(s)),
        ("percentage", is_percent(s)),
        ("ip_address", is_ip(s)),
        ("url", is_url(s)),
        ("boolean", F.lower(s).isin(*BOOLEANS)),
        ("gender", F.lower(s).isin(*GENDERS)),
        ("age", is_age(s)),
        ("address", is_address(s)),
        ("numeric_integer", s.rlike("^-?[0-9]+$")),
        ("numeric_float", number(s).isNotNull()),
    )
    out = F.lit("other")
    for name, passed in reversed(tests):
        out = F.when(passed, name).otherwise(out)
    return out

"""Normalizers from text to canonical text, numbers and booleans; all are Columns."""

from __future__ import annotations

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column

from .casts import bind, known, strip
from .dates import parse_any, parse_datetime

# Word lists and patterns.
TRUE_WORDS = ("true", "1", "yes", "y", "t", "active", "pass", "enable", "enabled")
FALSE_WORDS = ("false", "0", "no", "n", "f", "inactive", "fail", "disable", "disabled")
CURRENCY_WORDS = r"(?i)\b(pkr|rs\.?|usd|eur|gbp|inr|cents?|dollars?)\b"
CURRENCY_SIGNS = r"[$€£¥₹]"
AMOUNT = r"[-+]?[0-9]*\.?[0-9]+"
DURATION_PART = r"([0-9]+)\s*(hours?|hrs|hr|h|minutes?|mins|min|m|seconds?|secs|sec|s)"


def clean_phone(c: Column, prefix: str = "92") -> Column:
    """A Pakistani mobile number with the prefix 92, +92, 03 (0 and the ten digits), ``formatted``, or any other text."""
    digits = F.regexp_replace(known(c), r"[^0-9]", "")
    return bind(F.when(digits != "", F.ltrim(digits, F.lit("0"))), lambda bare: _phone(bare, prefix.strip()))


def _phone(bare: Column, prefix: str) -> Column:
    at = F.instr(bare, "3")
    tail = F.substring(bare, F.greatest(at, F.lit(1)), F.length(bare))
    body = (
        F.when(bare.rlike("^923.{9}$"), F.substring(bare, 3, 10))
        .when((F.length(bare) >= 10) & at.between(1, 3) & (F.length(tail) == 10), tail)
        .otherwise(bare)
    )
    if prefix == "formatted":
        spaced = lambda b: F.concat(F.lit("+92 "), F.substring(b, 1, 3), F.lit(" "), F.substring(b, 4, 7))
        return bind(body, lambda b: F.when(F.length(b) == 10, spaced(b)).otherwise(F.concat(F.lit("+92 "), b)))
    return F.concat(F.lit("0" if prefix == "03" else prefix), body)


def clean_intl_phone(c: Column) -> Column:
    """Digits and plus signs, if there are seven at least."""
    kept = F.regexp_replace(known(c), r"[^0-9+]", "")
    return F.when(F.length(kept) >= 7, kept)


def e164_phone(c: Column, region: str = "PK") -> Column:
    """International numbers as +digits where they are valid, else as clean_intl_phone gives them; needs phonenumbers."""
    try:
        import phonenumbers  # noqa: F401
    except ImportError as e:
        raise RuntimeError("numbers in E.164 need the package phonenumbers") from e

    @F.pandas_udf("string")
    def valid(s: pd.Series) -> pd.Series:
        import phonenumbers as P

        def one(x):
            try:
                parsed = P.parse(x, region)
            except P.NumberParseException:
                return None
            return P.format_number(parsed, P.PhoneNumberFormat.E164) if P.is_valid_number(parsed) else None

        return s.map(one, na_action="ignore")

    return F.coalesce(valid(known(c)), clean_intl_phone(c))


def clean_cnic(c: Column) -> Column:
    s = strip(c)
    digits = F.regexp_replace(s, r"[^0-9]", "")
    return F.when(F.length(digits) == 13, F.regexp_replace(digits, r"^([0-9]{5})([0-9]{7})([0-9])$", "$1-$2-$3")).when(s != "", s)


def to_datetime(c: Column) -> Column:
    """A timestamp from epoch seconds (10 digits), epoch milliseconds (13 digits) or one of the layouts."""
    s = known(c)
    epoch = s.try_cast("bigint")
    return (
        F.when(s.rlike("^[0-9]{10}$"), F.timestamp_seconds(epoch))
        .when(s.rlike("^[0-9]{13}$"), F.timestamp_millis(epoch))
        .otherwise(parse_datetime(s))
    )


def clean_datetime(c: Column, layout: str = "yyyy-MM-dd HH:mm:ss", any_layout: bool = False) -> Column:
    """The date in one layout. With ``any_layout`` texts in none of the known layouts go to a parser in Arrow batches."""
    found = to_datetime(c)
    return F.date_format(F.coalesce(found, parse_any(known(c))) if any_layout else found, layout)


def _clock(h: Column, m: Column, s: Column, layout: str) -> Column:
    return F.format_string(("%02d" if layout == "HH:MM:SS" else "%d") + ":%02d:%02d", h, m, s)


def clean_duration(c: Column, layout: str = "H:MM:SS") -> Column:
    """H:MM:SS or HH:MM:SS from seconds, clock times with or without AM and PM, and parts like 1h 30m; else the text as it is."""
    return bind(known(c), lambda s: _duration(s, layout))


def _duration(s: Column, layout: str) -> Column:
    seconds = s.try_cast("bigint")
    half = r"(?i)^([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?\s*([ap])m$"
    full = r"^([0-9]+):([0-9]{1,2})(?::([0-9]{1,2}))?$"

    def group(pattern: str, i: int) -> Column:
        return F.coalesce(F.regexp_extract(s, pattern, i).try_cast("bigint"), F.lit(0).cast("bigint"))

    h12 = group(half, 1)
    pm = F.lower(F.regexp_extract(s, half, 4)) == "p"
    hour = F.when(pm & (h12 != 12), h12 + 12).when(~pm & (h12 == 12), F.lit(0).cast("bigint")).otherwise(h12)

    def units(letter: str) -> Column:
        """Sum of the numbers before units with this first letter; an h anywhere in a unit makes it hours."""
        found = F.regexp_extract_all(s, F.lit(rf"(?i)([0-9]+)\s*{letter}"), 1)
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(x.try_cast("bigint"), F.lit(0)))

    total = units("h") * 3600 + units("m") * 60 + units("s")
    spoken = _clock(F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60, layout)
    of_seconds = _clock(F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60, layout)
    parsed = parse_datetime(s)
    return (
        F.when(s.rlike("^[0-9]+$") & seconds.isNotNull(), of_seconds)
        .when(s.rlike(half), _clock(hour, group(half, 2), group(half, 3), layout))
        .when(s.rlike(full), _clock(group(full, 1), group(full, 2), group(full, 3), layout))
        .when(s.rlike("(?i)" + DURATION_PART), spoken)
        .when(parsed.isNotNull(), _clock(F.hour(parsed).cast("bigint"), F.minute(parsed).cast("bigint"), F.second(parsed).cast("bigint"), layout))
        .otherwise(s)
    )


def clean_currency(c: Column) -> Column:
    """The first amount in a text, without currency words, signs and commas."""
    s = F.regexp_replace(F.regexp_replace(known(c), CURRENCY_WORDS, ""), CURRENCY_SIGNS, "")
    return F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), AMOUNT, 0).try_cast("double")


def clean_boolean(c: Column) -> Column:
    s = F.lower(strip(c.cast("string")))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def title(c: Column) -> Column:
    """Upper case at the start of each run of letters, also after apostrophes, dashes and digits (ASCII letters)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+|[^a-z]+)"), 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def clean_text(c: Column, casing: str | None = None, trim: bool = True) -> Column:
    """Single spaces, no control characters, the casing asked for; null if nothing is left."""
    s = c.cast("string")
    if trim:
        s = strip(F.regexp_replace(s, r"[\s\x1c-\x1f\x85\xa0]+", " "))
    s = F.regexp_replace(s, r"[\x00-\x1f\x7f-\x9f]", "")
    s = {"lower": F.lower, "upper": F.upper, "title": title}.get(casing or "", lambda x: x)(s)
    return F.when(s != "", s)

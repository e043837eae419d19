"""Dates and times in mixed layouts."""

from __future__ import annotations

import datetime

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column

from .casts import bind

#: Pattern of a text and the layout to read it with, tried in this order: month before day, unless only day first fits.
LAYOUTS = (
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2}$", "yyyy-M-d H:mm"),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "yyyy-M-d H:mm:ss"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{1,2}:[0-9]{2}$", "yyyy/M/d H:mm"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "yyyy/M/d H:mm:ss"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "M/d/yyyy H:mm:ss"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "d/M/yyyy H:mm:ss"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "M-d-yyyy H:mm:ss"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "d-M-yyyy H:mm:ss"),
    (r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
    (r"^[0-9]{1,2} [A-Z][a-z]{3,8} [0-9]{4}$", "d MMMM yyyy"),
    (r"^[A-Z][a-z]{3,8} [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"),
)
#: Fractions of a second and offsets after an ISO time; they are dropped, the clock time stays.
ISO_TAIL = r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{2}:[0-9]{2})(?:\.[0-9]+)?\s?(?:Z|[+-][0-9]{2}:?[0-9]{2})?$"


def parse_datetime(c: Column) -> Column:
    """A timestamp, or null where the text has none of the layouts or names no date."""
    def read(s: Column) -> Column:
        return F.coalesce(*(F.when(s.rlike(pattern), F.try_to_timestamp(s, F.lit(layout))) for pattern, layout in LAYOUTS))

    return bind(F.regexp_replace(c, ISO_TAIL, "$1"), read)


#: Two dates that differ in every part: what a parser takes from either is missing in the text.
_FILLERS = (datetime.datetime(2000, 1, 1), datetime.datetime(2004, 2, 2))


def parse_date_text(text: str) -> datetime.datetime | None:
    """A date in any layout that dateutil reads, if the text names year, month and day; offsets are dropped, as in ISO times."""
    import dateutil.parser

    try:
        one, two = (dateutil.parser.parse(text, default=d).replace(tzinfo=None) for d in _FILLERS)
    except (ValueError, OverflowError):
        return None
    return one if one == two else None


#: Words that dateutil knows, and those that Python reads as numbers.
_WORDS = """at on and ad m t of st nd rd th mon monday tue tuesday wed wednesday thu thursday fri friday sat saturday sun sunday jan
january feb february mar march apr april may jun june jul july aug august sep sept september oct october nov november dec december
h hour hours minute minutes s second seconds am a pm p utc gmt z nan inf infinity""".split()
#: A word that is none of those and too long, or not in capitals, for the name of a time zone.
_UNKNOWN = rf"(?<![A-Za-z])(?!(?i:{'|'.join(_WORDS)})(?![A-Za-z]))(?![A-Z]{{1,5}}(?![A-Za-z]))[A-Za-z]"


def no_date(c: Column) -> Column:
    """Whether a text of plain letters, digits and separators holds a word at which dateutil gives up. What follows "of" may be skipped there."""
    return c.rlike(r"\A[A-Za-z0-9 ,:/-]*\z") & ~c.rlike("(?i)(?<![a-z])of(?![a-z])") & c.rlike(_UNKNOWN)


def parse_any(c: Column) -> Column:
    """A timestamp by parse_date_text, in Arrow batches; only for texts that have a digit and five letters or more, and no
    word that rules out a date."""

    @F.pandas_udf("timestamp")
    def read(s: pd.Series) -> pd.Series:
        return pd.to_datetime(s.map(parse_date_text, na_action="ignore"), errors="coerce")

    return read(bind(c, lambda s: F.when(s.rlike("[0-9]") & (F.length(s) >= 5) & ~no_date(s), s)))

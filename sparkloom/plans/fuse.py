"""Decides a column's type from its name and from the kinds of its values. The first rule that holds decides."""

from __future__ import annotations

from dataclasses import dataclass

from ..schemas import CLOCK_TYPES, DATE_TYPES
from ..schemas import SemanticType as T


@dataclass(frozen=True)
class Evidence:
    """Shares of the values' kinds, the best type by name and its score, and a few statistics."""

    ratios: dict[T, float]
    name_type: T
    name_score: float
    is_text: bool
    distinct: int
    rows: int
    low: float | None = None
    high: float | None = None
    mean_length: float = 0.0


def decide(e: Evidence) -> tuple[T, float, str | None]:
    """(type, confidence up to 1, format)."""

    def r(t: T) -> float:
        return e.ratios.get(t, 0.0)

    n, named = e.name_score, e.name_type

    def mixed(share: float, by_values: float, by_name: float, plus: float, score: float = n) -> float:
        return min(1.0, share * by_values + score * by_name + plus)

    # Fixed values below: thresholds and weights of the rules.
    pk = r(T.PHONE_PAKISTAN)
    if pk > 0.40 or (pk > 0.20 and named == T.PHONE_PAKISTAN):
        return T.PHONE_PAKISTAN, mixed(pk, 0.5, 0.5, 0.2, n if named in (T.PHONE_PAKISTAN, T.PHONE_INTERNATIONAL) else 0.4), "923XXXXXXXXX"
    for t, alone, with_name, weights in (
        (T.PHONE_INTERNATIONAL, 0.60, 0.30, (0.6, 0.4, 0.0)),
        (T.CNIC_PAKISTAN, 0.50, 0.25, (0.6, 0.4, 0.15)),
        (T.EMAIL, 0.60, 0.30, (0.7, 0.3, 0.1)),
    ):
        if r(t) > alone or (r(t) > with_name and named == t):
            return t, mixed(r(t), *weights), None
    clock = max(r(T.DURATION), r(T.TIME))
    if r(T.DURATION) > 0.40 or (named in CLOCK_TYPES and (r(T.DURATION) > 0.20 or n > 0.65)):
        return (T.DURATION if named == T.DURATION else T.TIME), mixed(clock, 0.6, 0.4, 0.15, n if named in CLOCK_TYPES else 0.5), "H:MM:SS"
    if r(T.DATETIME) > 0.60 or (r(T.DATETIME) > 0.30 and named in DATE_TYPES):
        return (T.DATE if named == T.DATE else T.DATETIME), mixed(r(T.DATETIME), 0.6, 0.4, 0.1), "yyyy-MM-dd HH:mm:ss"
    if named == T.AGE and ((n > 0.70 and r(T.AGE) > 0.60) or (e.low is not None and e.high is not None and 0 <= e.low and e.high <= 115)):
        return T.AGE, 0.95, None
    if r(T.CURRENCY_AMOUNT) > 0.30 or (named == T.CURRENCY_AMOUNT and n > 0.65):
        return T.CURRENCY_AMOUNT, mixed(r(T.CURRENCY_AMOUNT), 0.5, 0.5, 0.2), None
    rules = (
        (r(T.PERCENTAGE) > 0.40 or (named == T.PERCENTAGE and n > 0.60), T.PERCENTAGE, 0.90),
        (r(T.IP_ADDRESS) > 0.50, T.IP_ADDRESS, 0.95),
        (r(T.URL) > 0.50, T.URL, 0.95),
        (r(T.BOOLEAN) > 0.85 and e.distinct <= 4, T.BOOLEAN, 0.95),
        (r(T.ADDRESS) > 0.35 or (named == T.ADDRESS and n > 0.70), T.ADDRESS, 0.85),
        (e.is_text and (e.distinct <= 25 or (e.rows > 50 and e.distinct / e.rows < 0.08)), T.CATEGORICAL, 0.85),
        (e.is_text and e.mean_length > 80, T.TEXT_LONG, 0.85),
        (r(T.NUMERIC_INTEGER) > 0.85 and named == T.IDENTIFIER_ID, T.IDENTIFIER_ID, 0.90),
        (r(T.NUMERIC_INTEGER) > 0.85, T.NUMERIC_INTEGER, 0.85),
        (r(T.NUMERIC_FLOAT) > 0.70 or r(T.NUMERIC_INTEGER) + r(T.NUMERIC_FLOAT) > 0.80, T.NUMERIC_FLOAT, 0.85),
        (n > 0.75, named, n),
        (e.is_text, T.TEXT_GENERIC, 0.60),
    )
    return next(((t, c, None) for holds, t, c in rules if holds), (T.UNKNOWN, 0.40, None))

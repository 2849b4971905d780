"""Dates given as text, and relative weekdays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shortest and the complete digits of YYYYMMDDhhmmssffffff.
_FLOOR_TAIL = "0101000000000000"


def date_digits(text: Column) -> Column:
    """The digits of a (partial) date; blanks, ``-``, ``.`` and ``:`` are ignored; null if anything else is there."""
    digits = F.regexp_replace(text, r"[ \-.:]", "")
    return F.when(digits.rlike(r"^(\d{4}|\d{6}|\d{8}|\d{10}|\d{12}|\d{14}|\d{20})$"), digits)


def _stamp(digits: Column) -> Column:
    p = lambda a, n: F.substring(digits, a, n)
    text = F.concat(p(1, 4), F.lit("-"), p(5, 2), F.lit("-"), p(7, 2), F.lit(" "), p(9, 2), F.lit(":"), p(11, 2), F.lit(":"), p(13, 2), F.lit("."), p(15, 6))
    return text.try_cast("timestamp_ntz")


def date_floor(text: Column) -> Column:
    """The first moment of the period a partial date names."""
    d = date_digits(text)
    return _stamp(F.concat(d, F.substring(F.lit(_FLOOR_TAIL), F.length(d) - 3, F.lit(16))))


def date_ceil(text: Column) -> Column:
    """The last microsecond of the period a partial date names."""
    d, lo = date_digits(text), date_floor(text)
    n = F.length(d)
    step = (F.when(n == 4, F.make_interval(years=F.lit(1))).when(n == 6, F.make_interval(months=F.lit(1)))
            .when(n == 8, F.make_interval(days=F.lit(1))).when(n == 10, F.make_interval(hours=F.lit(1)))
            .when(n == 12, F.make_interval(mins=F.lit(1))).when(n == 14, F.make_interval(secs=F.lit(1)))
            .otherwise(F.make_interval(secs=F.lit(0.000001))))
    return lo + step - F.expr("interval 1 microsecond")


def relative_weekday(day: Column, weekday: str, direction: int) -> Column:
    """Next (1) or last (-1) weekday; the same weekday is a whole week away."""
    nxt = F.next_day(day, weekday)
    if direction > 0:
        return nxt
    back = F.date_sub(nxt, 7)
    return F.when(back == F.to_date(day), F.date_sub(nxt, 14)).otherwise(back)

"""Calendar arithmetic as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 1970-01-01 was a Thursday, three days after a Monday.
_EPOCH_TO_MONDAY = 3


def _weekdays_through(day: Column) -> Column:
    """Number of Monday-to-Friday days from a fixed Monday through ``day``."""
    since_monday = F.unix_date(day) + F.lit(_EPOCH_TO_MONDAY)
    day_of_week = F.pmod(since_monday, F.lit(7))
    full_weeks = ((since_monday - day_of_week) / F.lit(7)).cast("int")
    return full_weeks * 5 + F.least(day_of_week + F.lit(1), F.lit(5))


def business_days_between(start: Column, end: Column) -> Column:
    """Weekdays in ``(start, end]``: 0 when ``end <= start``, NULL when either is NULL.

    The difference of two running counts, so the cost does not depend on the gap and
    the expression stays inside generated code.
    """
    gap = _weekdays_through(end) - _weekdays_through(start)
    # greatest() skips NULLs, so the guard is needed to keep NULL in, NULL out.
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0), gap)).cast("int")

"""Dates from epochs and texts; the current day is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickersieve.functions.numbers import finite

# First and last instant with a four-digit year, in epoch seconds.
_MIN_EPOCH = -62135596800.0
_MAX_EPOCH = 253402300799.0
_EPOCH_DAY = dt.date(1970, 1, 1)


def as_date(as_of: str | dt.date | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    day = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(as_of)
    return F.lit(day)


def epoch_to_date(seconds: Column, positive_only: bool = True) -> Column:
    """UTC day of an epoch; out-of-range values give NULL. Independent of the session zone."""
    number = finite(seconds.cast("double"))
    low = F.lit(0.0) if positive_only else F.lit(_MIN_EPOCH)
    usable = (number > low) & (number <= F.lit(_MAX_EPOCH))
    days = F.floor(F.when(usable, number) / 86400.0).cast("int")
    return F.date_add(F.lit(_EPOCH_DAY), days)


def text_to_date(text: Column) -> Column:
    return F.substring(text.cast("string"), 1, 10).try_cast("date")


def days_until(day: Column, as_of: str | dt.date | Column) -> Column:
    return F.datediff(day, as_date(as_of))


def recent_weekdays(as_of: str | dt.date | Column, days_back: int) -> Column:
    """Array of the last calendar days without weekends, latest first."""
    today = as_date(as_of)
    days = F.sequence(today, F.date_sub(today, days_back - 1), F.expr("interval -1 day"))
    return F.filter(days, lambda d: F.weekday(d) < 5)

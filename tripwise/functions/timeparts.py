"""Calendar parts of a pickup timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pickup_hour(ts: str | Column) -> Column:
    return F.hour(ts)


def monday_based_day(ts: str | Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(ts)


def sunday_based_day(ts: str | Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(ts)


def is_weekend_day(day: str | Column, days: str = "sat_sun") -> Column:
    """Of a day numbered from Sunday: ``sat_sun`` is the calendar weekend, ``fri_sat`` is day 6 and up."""
    day = F.col(day) if isinstance(day, str) else day
    if days == "sat_sun":
        return day.isin(7, 1)
    if days == "fri_sat":
        return day >= 6
    raise ValueError(f"Unknown weekend definition: {days}")

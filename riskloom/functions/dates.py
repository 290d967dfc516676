"""Dates. No function here reads the clock: ``as_of`` is always passed in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def years_before(as_of: dt.date | str, years: int) -> Column:
    """The same day ``years`` earlier; 29 February becomes the 28th."""
    return F.add_months(day(as_of), -12 * years)


def us_date(text: Column) -> Column:
    """``M/D/YYYY`` text, one or two digits each; null when it is no such date."""
    return F.try_to_date(text, "M/d/yyyy")


def sunday_based_weekday(date: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(date) - 1


def month_start(moment: Column) -> Column:
    return F.date_trunc("month", moment)

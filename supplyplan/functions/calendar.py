"""Calendar expressions.

The plan calendar counts weeks from 1 January (week 1 is days 1-7, week 53 the last
one or two days), which is neither ISO nor Monday based. ISO Mondays occur too, as
the label of a demand week. The clock is always a parameter.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

VIEWS = ("WEEK", "MONTH", "YEAR")

# Month names of the audit stamp in task messages.
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN",
           "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def plan_week(day: Column) -> Column:
    """Week of the year, 1-53, counted in sevens from 1 January."""
    return F.floor((F.dayofyear(day) + F.lit(6)) / F.lit(7)).cast("int")


def plan_week_of(day: date) -> int:
    """`plan_week` of a Python date."""
    return (day.timetuple().tm_yday + 6) // 7


def week_dates(year: int, week: int) -> tuple[date, date]:
    """First day of a plan week and the first day after it, clipped to its year.

    A test of week and year on a date column is the same as a range test, and unlike
    the function calls a range reaches the Parquet scan.
    """
    if not 1 <= week <= 53:
        raise ValueError(f"plan week out of range: {week}")
    first = date(year, 1, 1) + timedelta(days=7 * (week - 1))
    return first, min(first + timedelta(days=7), date(year + 1, 1, 1))


def iso_monday(day: Column) -> Column:
    return F.trunc(day, "week")


def view_bucket(view: str, day: Column) -> tuple[Column, Column]:
    """Bucket number and bucket date of a calendar view; other views fall back to WEEK."""
    if view == "MONTH":
        return F.month(day), F.trunc(day, "month")
    if view == "YEAR":
        return F.year(day), F.trunc(day, "year")
    return plan_week(day), day


def as_datetime(as_of: date | datetime) -> datetime:
    if isinstance(as_of, datetime):
        return as_of
    return datetime(as_of.year, as_of.month, as_of.day)


def timestamp_literal(as_of: date | datetime) -> Column:
    """The batch clock as a zone-free timestamp with second precision."""
    return F.lit(as_datetime(as_of).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def stamp_text(as_of: date | datetime) -> str:
    """The batch clock as it is written into task messages."""
    ts = as_datetime(as_of)
    return f"{ts:%d}-{_MONTHS[ts.month - 1]}-{ts:%Y %H:%M:%S}"

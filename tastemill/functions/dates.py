"""Calendar helpers. The reference day is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days back from the anchor for each window (fixed values).
COMPARE_DAYS = 56
YEAR_SHIFT_DAYS = 364
YEAR_WINDOW_DAYS = 366
BROWSE_DAYS = 49
RECENT_DAYS = 30
HISTORY_DAYS = 3 * 365
FEED_DAYS = 60
CART_DAYS = 7


def last_saturday(day: Column) -> Column:
    """The Saturday strictly before ``day``."""
    return F.date_sub(day, F.pmod(F.weekday(day) + 1, F.lit(7)) + 1)


def next_sunday(day: Column) -> Column:
    """The Sunday on or after ``day``."""
    return F.date_add(day, 6 - F.weekday(day))


def date_windows(day: Column) -> dict[str, Column]:
    """Begin and end of every reporting window, derived from the run day."""
    saturday = last_saturday(day)
    return {
        "this_year_begin": F.date_sub(day, COMPARE_DAYS),
        "this_year_end": day,
        "last_year_begin": F.date_sub(day, YEAR_SHIFT_DAYS + COMPARE_DAYS),
        "last_year_end": F.date_sub(day, YEAR_SHIFT_DAYS),
        "year_begin": F.date_sub(saturday, YEAR_WINDOW_DAYS),
        "year_end": saturday,
        "two_year_begin": F.date_sub(saturday, YEAR_WINDOW_DAYS + 365),
        "browse_begin": F.date_sub(saturday, BROWSE_DAYS),
        "recent_begin": F.date_sub(saturday, RECENT_DAYS),
        "history_begin": F.date_sub(saturday, HISTORY_DAYS),
        "feed_begin": F.date_sub(day, FEED_DAYS),
        "cart_begin": F.date_sub(day, CART_DAYS),
        "week_begin": next_sunday(day),
        "week_end": F.date_add(next_sunday(day), 6),
    }


def run_windows(as_of: dt.date) -> dict[str, tuple[dt.date, dt.date]]:
    """The windows of one run as plain dates, for use as filter parameters."""
    saturday = as_of - dt.timedelta(days=(as_of.weekday() + 1) % 7 + 1)
    back = lambda n: dt.timedelta(days=n)
    return {
        "browse": (saturday - back(BROWSE_DAYS), saturday),
        "recent": (saturday - back(RECENT_DAYS), saturday),
        "history": (saturday - back(HISTORY_DAYS), saturday),
        "year": (saturday - back(YEAR_WINDOW_DAYS), saturday),
    }


def date_from_text(text: Column) -> Column:
    """Date part of a date-time text, cut at the first blank; null when unreadable."""
    return F.try_to_date(F.substring_index(text, " ", 1), "yyyy-MM-dd")


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def weekday_mon0(day: Column) -> Column:
    """Monday is 0, Sunday 6."""
    return F.weekday(day)


def same_month_last_year(yyyymm: Column) -> Column:
    return yyyymm - 100

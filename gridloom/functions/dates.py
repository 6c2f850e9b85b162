"""Periods, deadlines and calendar-safe shifts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_end(period: Column) -> Column:
    """First day after a period text: 2024, 2024-Q3, 2024-07 or 2024-07-15; null if it is none of these."""
    year = F.regexp_extract(period, r"^(\d{4})", 1)
    quarter = F.regexp_extract(period, r"^\d{4}-?[Qq]([1-4])$", 1).try_cast("int")
    start = lambda month: F.concat(year, F.lit("-"), month, F.lit("-01")).try_cast("date")
    return (
        F.when(period.rlike(r"^\d{4}$"), F.add_months(start(F.lit("01")), 12))
        .when(quarter.isNotNull(), F.add_months(start(F.lit("01")), quarter * 3))
        .when(period.rlike(r"^\d{4}-\d{2}$"), F.add_months(start(F.substring(period, 6, 2)), 1))
        .when(period.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_add(period.try_cast("date"), 1))
    )


def shift_period(period: Column, months: int) -> Column:
    """A ``YYYY-MM`` text some months on or back; null if it is no month."""
    return F.date_format(F.add_months(F.concat(period, F.lit("-01")).try_cast("date"), months), "yyyy-MM")


def year_month(year: Column, month: Column) -> Column:
    """``YYYY-MM``, or ``YYYY`` where the month is missing."""
    return F.when(month.isNull(), F.format_string("%04d", year)).otherwise(F.format_string("%04d-%02d", year, month))


def same_day_before(day: Column, months: int) -> Column:
    """The same day of the month ``months`` before, null where that month has no such day."""
    back = F.add_months(day, -months)
    return F.when(F.dayofmonth(back) == F.dayofmonth(day), back)


def served_status(status: Column, due: Column, now: Column) -> Column:
    """``closed`` for an open notice past its deadline, else the status."""
    return F.when((status == "open") & (due < now), "closed").otherwise(status)


def average_rate(total: Column, year: Column) -> Column:
    """A yearly total divided by the hours of its year."""
    days = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return total / (days * 24)

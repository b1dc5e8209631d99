"""Run-date arithmetic on the driver; the results go into plans as literals, so scans are pruned."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: date | str) -> date:
    """Accept a date, a datetime (its day counts) or ISO text."""
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(value)


def run_days(run_date: date | str) -> list[date]:
    """The run date and the day before it."""
    day = as_date(run_date)
    return [day, day - timedelta(days=1)]


def month_text(day: date) -> str:
    """Two-digit month, as in partition values."""
    return f"{day.month:02d}"


def day_text(day: date) -> str:
    """Two-digit day of the month, as in partition values."""
    return f"{day.day:02d}"


def run_date_predicate(run_date: date | str, month: str = "month", day: str = "day", *, mode: str = "dates") -> Column:
    """The partitions of the run date and the day before, on two-digit text columns.

    `dates` asks for these two dates. `cross` asks for the month of the run date with either day,
    so on the first of a month it names a day that is not the one before.
    """
    days = run_days(run_date)
    if mode == "cross":
        return (F.col(month) == month_text(days[0])) & F.col(day).isin([day_text(d) for d in days])
    if mode != "dates":
        raise ValueError(f"unknown mode {mode}")
    first, second = [(F.col(month) == month_text(d)) & (F.col(day) == day_text(d)) for d in days]
    return first | second

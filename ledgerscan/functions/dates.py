"""Date functions on coerced timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MICROS = 86_400_000_000


def elapsed_days(end: Column, start: Column) -> Column:
    """Whole days between two moments, rounded down (not the number of midnights)."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(_DAY_MICROS)))


def date_difference(start: Column, end: Column, unit: str = "D") -> Column:
    """Elapsed days, or months of 30.4375 days, or years of 365.25 days."""
    days = elapsed_days(end, start)
    per_unit = {"Y": 365.25, "M": 30.4375}.get(str(unit).upper())
    return days if per_unit is None else F.floor(days / F.lit(per_unit))


def iso_weekday(ts: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(ts) + 1

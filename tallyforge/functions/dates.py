"""Months, years and durations in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def duration_days(begin: Column, end: Column) -> Column:
    """Whole days between two times, halves up; null if the end comes first."""
    ms = F.unix_millis(end.cast("timestamp")) - F.unix_millis(begin.cast("timestamp"))
    return F.when(ms >= 0, F.floor(ms / 86_400_000.0 + 0.5).cast("long"))


def freshness(day: Column, as_of: str, half_life: float = 365.0) -> Column:
    """Weight that halves with every half_life days before as_of; 1/2 without a date."""
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), day), F.lit(0))
    return F.when(day.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), age / half_life))

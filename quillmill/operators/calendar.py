"""ISO weeks and display of times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def monday(day: Column) -> Column:
    return F.date_sub(day.cast("date"), F.weekday(day))

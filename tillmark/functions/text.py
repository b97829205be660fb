"""Display texts: money, counts, percentages, hours, quarters, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONTHS, WEEKDAYS
from .numeric import half_even


def plain_number(value: Column, digits: int) -> Column:
    """Fixed decimals without thousands separators."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def money(value: Column, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, digits))


def count_text(value: Column) -> Column:
    return F.format_number(value, 0)


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(plain_number(value, digits), F.lit("%"))


def signed(text: Column, value: Column) -> Column:
    """Put a plus sign in front of values that are not negative."""
    return F.concat(F.when(value >= 0, F.lit("+")).otherwise(F.lit("")), text)


def thousands(value: Column) -> Column:
    return F.concat(F.lit("$"), half_even(value / 1000).cast("long").cast("string"), F.lit("k"))


def hour_label(hour: Column) -> Column:
    return F.concat(hour.cast("string"), F.lit(":00"))


def quarter_label(quarter: Column) -> Column:
    return F.concat(F.lit("Q"), quarter.cast("string"))


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month)


def weekday_label(weekday_num: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), weekday_num + 1)


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "hh:mm a")


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def second_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")

"""Columns derived from one transaction row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import weekday_label


def enrich(df: DataFrame) -> DataFrame:
    """Add revenue and the calendar columns. Unused ones are pruned by the optimizer."""
    when = F.col("transaction_time")
    return df.withColumns(
        {
            "revenue": F.col("transaction_qty") * F.col("unit_price"),
            "date": F.to_date(when),
            "hour": F.hour(when),
            "month": F.month(when),
            "quarter": F.quarter(when),
            "weekday": weekday_label(F.weekday(when)),
            "weekday_num": F.weekday(when),
            "is_weekend": (F.weekday(when) >= 5).cast("int"),
        }
    )


def calendar_features(df: DataFrame) -> DataFrame:
    """Add the day of month and renew month and weekday number from the date."""
    return df.withColumns(
        {
            "day": F.dayofmonth("date"),
            "month": F.month("date"),
            "weekday_num": F.weekday("date"),
        }
    )


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns, as far as the frame has them."""
    return df.select(*[c for c in wanted if c in df.columns])

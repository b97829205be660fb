"""Row filters. Each is a plain predicate, so it reaches the Parquet scan where it can."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def for_store(df: DataFrame, store: str | None) -> DataFrame:
    """Rows of one store; all rows for None."""
    return df if store is None else df.where(F.col("store_location") == store)


def positive(df: DataFrame, column: str = "y") -> DataFrame:
    return df.where(F.col(column) > 0)


def moment(df: DataFrame, as_of: datetime | str | None) -> Column:
    """``as_of`` as a timestamp; by default the time of the latest transaction."""
    if as_of is not None:
        return F.lit(as_of).cast("timestamp")
    return df.agg(F.max("transaction_time")).scalar()


def recent(df: DataFrame, minutes: int, as_of: datetime | str | None = None) -> DataFrame:
    """Rows of the last ``minutes`` up to ``as_of``, both ends included."""
    end = moment(df, as_of)
    start = end - F.make_dt_interval(mins=F.lit(minutes))
    return df.where((F.col("transaction_time") >= start) & (F.col("transaction_time") <= end))


def flagged(df: DataFrame, flag: str = "is_anomaly", value: bool = True) -> DataFrame:
    return df.where(F.col(flag) if value else ~F.col(flag))


def among(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is one of the values; an empty choice keeps all rows."""
    return df.where(F.col(column).isin(list(values))) if values else df


def keys_with_label(df: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """Sorted keys that carry a label, one row each."""
    return df.where(F.col(label) == value).select(key).orderBy(key)


def with_history(df: DataFrame, count: str, minimum: int) -> DataFrame:
    return df.where(F.col(count) >= minimum)


def choices(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values for a selector."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)

"""Sorting, top-k and sampling. Each top-k runs per task first and never sorts everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..functions.text import hour_label, second_text
from .enrich import present

FEED_COLUMNS = [
    "transaction_time", "store_location", "product_category", "product_type",
    "transaction_qty", "unit_price", "revenue",
]


def sort_desc(df: DataFrame, metric: str, *keys: str) -> DataFrame:
    return df.orderBy(F.desc(metric), *keys)


def by_weekday(df: DataFrame) -> DataFrame:
    """Monday to Sunday."""
    return df.orderBy("weekday_num")


def busiest_slots(staff: DataFrame, n: int = 20) -> DataFrame:
    """The store-hours that need most staff."""
    top = staff.orderBy(F.desc("Required Staff"), "store_location", "hour").limit(n)
    return top.select(
        F.col("store_location").alias("Store"),
        hour_label(F.col("hour")).alias("Hour"),
        "Transactions",
        F.col("Required Staff").alias("Staff Required"),
    )


def latest(df: DataFrame, n: int = 20) -> DataFrame:
    """The latest n transactions; of equal time and id, by all other columns."""
    rest = [c for c in df.columns if c not in ("transaction_time", "transaction_id")]
    return df.orderBy(F.desc("transaction_time"), F.desc("transaction_id"), *rest).limit(n)


def live_feed(df: DataFrame, n: int = 20) -> DataFrame:
    """The latest n transactions as a display feed."""
    feed = present(latest(df, n), FEED_COLUMNS)
    if "revenue" in feed.columns:
        feed = feed.withColumn("revenue", half_even(F.col("revenue"), 2))
    return feed.withColumn("transaction_time", second_text(F.col("transaction_time")))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """n rows in a seeded pseudo-random order: the same rows on every run, however partitioned.

    The order is that of a hash of the row, or of ``keys``, which then draws all rows of a key together.
    """
    parts = [F.col(c).cast("string") for c in keys or df.columns]
    ticket = F.md5(F.concat_ws("-", *parts, F.lit(str(seed))).cast("binary"))
    return df.orderBy(ticket, *(keys or []), *df.columns).limit(n)

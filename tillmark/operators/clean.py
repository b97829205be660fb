"""Cleaning, in a fixed order: duplicates, missing times, quantities, prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_number
from ..functions.ordered import exact_quantiles
from ..session import shared_path
from ..sources.sinks import write_table


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of each set of rows that agree in all columns (nulls agree with nulls).

    Grouping on all columns combines copies on the map side, so a hot row is one row per task
    before the shuffle.
    """
    return df.dropDuplicates()


def drop_missing_time(df: DataFrame) -> DataFrame:
    return df.where(F.col("transaction_time").isNotNull())


def _numeric(df: DataFrame, column: str):
    return to_number(F.col(column), df.schema[column].dataType.simpleString())


def coerce_quantity(df: DataFrame) -> DataFrame:
    """Quantities as doubles; whatever is no number becomes 0."""
    return df.withColumn("transaction_qty", F.coalesce(_numeric(df, "transaction_qty"), F.lit(0.0)))


def price_median(df: DataFrame) -> float | None:
    """Exact median of the usable prices; null if there is none. One value reaches the driver."""
    prices = df.select(_numeric(df, "unit_price").alias("price"))
    found = exact_quantiles(prices, "price", [0.5]).first()
    return None if found is None else found["quantiles"][0]


def impute_price(df: DataFrame, median: float | None = None) -> DataFrame:
    """Prices as doubles; whatever is no number becomes the median of the others.

    The median costs a pass over the data, so it is only computed when a price is missing;
    that check stops at the first one, and Parquet statistics answer it for typed tables.
    """
    price = _numeric(df, "unit_price")
    return df.withColumn("unit_price", F.coalesce(price, F.lit(median).cast("double")))


def clean(df: DataFrame, median: float | None = None, store: str | None = None) -> DataFrame:
    """Whole cleaning step. Pass ``median`` to use a known price median (as streams must).

    Removing duplicates shuffles whole rows, and a missing price needs the result twice: for
    the median and for the rows. Unless the median is known, the distinct rows are therefore written once, to ``store`` or
    a path of their own in the shared folder; the median then reads a single column of that table.
    """
    rows = drop_missing_time(drop_duplicate_rows(df))
    if median is None:
        rows = write_table(rows, store or shared_path(df.sparkSession, "distinct-rows"))
        if not rows.where(_numeric(rows, "unit_price").isNull()).limit(1).isEmpty():
            median = price_median(rows)
    elif store is not None:
        rows = write_table(rows, store)
    return impute_price(coerce_quantity(rows), median)

"""Demand levels and demand pattern headline numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import revenue, rows, units
from ..functions.ordered import key_of_best
from ..schema import DEMAND_LEVELS
from .kpi import value_counts, weekday_hour_units


def quartile_levels(slots: DataFrame, value: str = "transaction_qty") -> DataFrame:
    """Label rows by quartile of ``value``; all get "Medium" when two quartile limits coincide.

    For slot tables of bounded size (7 x 24 weekday hours).
    """
    edges = slots.agg(F.percentile(value, F.lit([0.0, 0.25, 0.5, 0.75, 1.0]))).scalar()
    low, medium, high, extreme = (F.lit(name) for name in DEMAND_LEVELS)
    v = F.col(value)
    coincide = F.lit(False)
    for i in range(4):
        coincide = coincide | (edges[i] >= edges[i + 1])
    level = (
        F.when(coincide, medium)
        .when(v <= edges[1], low)
        .when(v <= edges[2], medium)
        .when(v <= edges[3], high)
        .otherwise(extreme)
    )
    return slots.withColumn("Demand_Level", level)


def demand_levels(df: DataFrame) -> DataFrame:
    """Units and demand level of each weekday hour."""
    return quartile_levels(weekday_hour_units(df))


def level_distribution(levels: DataFrame) -> DataFrame:
    return value_counts(levels, "Demand_Level")


def pattern_kpis(df: DataFrame) -> DataFrame:
    """One row: hour with the largest and smallest mean basket, busiest weekday, best month.

    One pass over the facts; the three breakdowns are grouping sets over the small aggregate
    by hour, weekday and month.
    """
    keys = ["hour", "weekday", "month"]
    slots = df.groupBy(*keys).agg(
        units().alias("transaction_qty"), revenue().alias("revenue"), rows(df).alias("row_count")
    )
    sets = slots.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("level"),
        units().alias("units"),
        revenue().alias("revenue"),
        F.sum("row_count").alias("row_count"),
    )
    # The level has a bit per key that is summed away, the first key being the highest bit.
    by_hour, by_weekday, by_month = (F.col("level") == n for n in (0b011, 0b101, 0b110))
    basket, hour = F.col("units") / F.col("row_count"), F.col("hour")
    return sets.agg(
        key_of_best(basket, hour, by_hour).alias("peak_hour"),
        key_of_best(F.col("units"), F.col("weekday"), by_weekday).alias("busiest_day"),
        key_of_best(F.col("revenue"), F.col("month"), by_month).alias("best_month"),
        key_of_best(basket, hour, by_hour, largest=False).alias("quietest_hour"),
    )

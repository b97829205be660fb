"""Headline numbers and breakdowns by store, category and calendar.

All operators group on at most a few columns and combine on the map side, so a key that holds
a third of all rows still reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ids, revenue, rows, units
from ..functions.numeric import ratio
from ..functions.ordered import exact_quantiles, key_of_best
from ..functions.text import count_text, money, quarter_label, thousands
from ..session import durable


def known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose grouping keys are all known; none if the frame lacks a key column."""
    for key in keys:
        if key not in df.columns:
            df = df.withColumn(key, F.lit(None).cast("string"))
        df = df.where(F.col(key).isNotNull())
    return df


def kpis(df: DataFrame) -> DataFrame:
    """One row: revenue, rows, units, average order value, best store, best category.

    The facts are read once, into a store x category aggregate. Grouping sets over that small
    frame give the totals per store, per category and overall in one more aggregation.
    """
    store, category = "store_location", "product_category"
    lacking = [k for k in (store, category) if k not in df.columns]
    df = df.withColumns({k: F.lit(None).cast("string") for k in lacking})
    pairs = df.groupBy(store, category).agg(
        revenue().alias("revenue"), rows(df).alias("row_count"), units().alias("transaction_qty")
    )
    sets = pairs.groupingSets([[store], [category], []], store, category).agg(
        F.grouping_id().alias("level"),
        revenue().alias("revenue"),
        F.sum("row_count").alias("row_count"),
        units().alias("transaction_qty"),
    )
    # The level has a bit per key that is summed away: 1 per store, 2 per category, 3 overall.
    level, money_ = F.col("level"), F.col("revenue")

    def whole(column: str, empty: Column) -> Column:
        return F.coalesce(F.max(F.when(level == 3, F.col(column))), empty)

    def best(key: str, at: int) -> Column:
        return F.lit("N/A") if key in lacking else key_of_best(money_, F.col(key), level == at)

    return sets.agg(
        whole("revenue", F.lit(0.0)).alias("Revenue"),
        whole("row_count", F.lit(0).cast("long")).alias("Transactions"),
        whole("transaction_qty", F.lit(0.0)).alias("Quantity"),
        best(store, 1).alias("Best_Store"),
        best(category, 2).alias("Best_Category"),
    ).withColumn("Avg_Order_Value", ratio(F.col("Revenue"), F.col("Transactions"), 0.0))


def store_performance(df: DataFrame) -> DataFrame:
    """Revenue, transactions with an id, and units per store, best first."""
    return (
        known(df, "store_location")
        .groupBy("store_location")
        .agg(revenue().alias("Revenue"), ids(df).alias("Transactions"), units().alias("Quantity"))
        .orderBy(F.desc("Revenue"), "store_location")
    )


def category_totals(df: DataFrame) -> DataFrame:
    return (
        known(df, "product_category")
        .groupBy("product_category")
        .agg(revenue().alias("Revenue"), units().alias("Quantity"))
    )


def daily_sales(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(revenue().alias("Revenue"), units().alias("Quantity"))


def hourly_demand(df: DataFrame) -> DataFrame:
    return df.groupBy("hour").agg(units().alias("Quantity"), revenue().alias("Revenue"))


def hourly_mean_units(df: DataFrame) -> DataFrame:
    """Mean units per row (basket line) for each hour of the day."""
    return df.groupBy("hour").agg((units() / rows(df)).alias("Avg_Transactions"))


def weekday_units(df: DataFrame) -> DataFrame:
    """Units per weekday; ``weekday_num`` carries the Monday-to-Sunday order."""
    return df.groupBy("weekday_num", "weekday").agg(units().alias("Transactions"))


def monthly_revenue(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(revenue().alias("Revenue"))


def weekday_hour_units(df: DataFrame) -> DataFrame:
    return df.groupBy("weekday_num", "weekday", "hour").agg(units().alias("transaction_qty"))


def quarterly_revenue(df: DataFrame) -> DataFrame:
    quarters = df.groupBy("quarter").agg(revenue().alias("revenue"))
    return quarters.select(
        "*",
        quarter_label(F.col("quarter")).alias("quarter_label"),
        thousands(F.col("revenue")).alias("revenue_label"),
    )


def distinct_transactions(df: DataFrame, approximate: float | None = None) -> DataFrame:
    """Distinct transaction ids per store, most first.

    Exact counting shuffles (store, id) pairs, so a hot store spreads over all tasks.
    ``approximate`` sets a relative error and switches to a sketch.
    """
    ids_ = F.col("transaction_id")
    counted = F.countDistinct(ids_) if approximate is None else F.approx_count_distinct(ids_, approximate)
    return (
        known(df, "store_location")
        .groupBy("store_location")
        .agg(counted.alias("transaction_id"))
        .orderBy(F.desc("transaction_id"), "store_location")
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """Numbers of stores and of categories, from the distinct pairs of both."""
    pairs = df.select("store_location", "product_category").distinct()
    return pairs.agg(
        F.countDistinct("store_location").alias("stores"),
        F.countDistinct("product_category").alias("categories"),
    )


def store_revenue(df: DataFrame) -> DataFrame:
    return (
        known(df, "store_location")
        .groupBy("store_location")
        .agg(revenue().alias("revenue"))
        .orderBy(F.desc("revenue"), "store_location")
    )


def daily_spread(df: DataFrame, key: str) -> DataFrame:
    """Per key: mean, deviation, sum and number of the daily units, and the total revenue.

    Days without sales do not count. Revenue rides along in the same two aggregations, so no
    second pass and no join is needed for it.
    """
    daily = (
        known(df, key)
        .groupBy(key, "date")
        .agg(units().alias("transaction_qty"), revenue().alias("revenue"))
    )
    return daily.groupBy(key).agg(
        F.avg("transaction_qty").alias("mean_units"),
        F.stddev_samp("transaction_qty").alias("std_units"),
        units().alias("total_units"),
        F.count(F.lit(1)).alias("days"),
        revenue().alias("revenue"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        known(df, column)
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("Count"))
        .orderBy(F.desc("Count"), column)
    )


def count_matching(df: DataFrame, condition: Column, name: str) -> DataFrame:
    return df.agg(F.count_if(condition).alias(name))


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """Sum, largest, smallest and mean value of a result column."""
    return df.agg(
        F.sum(column).alias("sum"),
        F.max(column).alias("max"),
        F.min(column).alias("min"),
        F.avg(column).alias("mean"),
    )


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Add each row's part of the column total, for a frame of results.

    The frame is made durable, so that rows and total read it instead of the facts twice; a
    window without keys would move all rows to one task.
    """
    kept = durable(df)
    whole = kept.agg(F.sum(value)).scalar()
    return kept.withColumn(name, ratio(F.col(value), whole))


def histogram(df: DataFrame, column: str, bins: int = 30, weight: str | None = None) -> DataFrame:
    """Counts in ``bins`` equal parts of the value range, numbered from 1; empty ones are absent.

    Reads the column twice: for its limits and to count.
    ``weight`` names a column that says how many rows a row stands for.
    """
    limits = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("limits"))
    bounds = limits.scalar()
    low, high = bounds.getField("low"), bounds.getField("high")
    place = F.floor(ratio(F.col(column) - low, high - low, 0.0) * bins) + 1
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.least(F.lit(bins), place).cast("int").alias("bin"))
        .agg((F.sum(weight).cast("long") if weight else F.count(F.lit(1))).alias("count"))
    )


def five_numbers(
    df: DataFrame, column: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Smallest value, quartiles and largest value, exact, optionally per group."""
    names = ["min", "q1", "median", "q3", "max"]
    found = exact_quantiles(df, column, [0, 0.25, 0.5, 0.75, 1], by, weight)
    return found.select(*by, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)])


def store_table(df: DataFrame) -> DataFrame:
    """Store performance as display texts."""
    return store_performance(df).select(
        F.col("store_location").alias("Store"),
        money(F.col("Revenue")).alias("Revenue"),
        count_text(F.col("Transactions")).alias("Transactions"),
        count_text(F.col("Quantity")).alias("Units Sold"),
    )

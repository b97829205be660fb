"""Inventory planning per category and supply-chain numbers per store."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.measures import revenue, units
from ..functions.numeric import MONEY, half_even, ratio, spread
from ..functions.ordered import running_sum
from ..functions.text import percent
from ..schema import ABC_CUTS, BAND_Z, HOLDING_RATE, ORDER_BUFFER, ORDER_COST, RISK_CUTS
from .kpi import daily_spread, known, value_counts


def abc_classes(df: DataFrame, key: str = "product_category") -> DataFrame:
    """Class A up to 70 % of cumulative revenue, B up to 90 %, then C; best seller first.

    Works for any number of keys: the running sum is taken range by range, in exact decimals,
    and the facts are read once.
    """
    totals = known(df, key).groupBy(key).agg(revenue().alias("Revenue"), units().alias("Quantity"))
    totals = totals.withColumn("_exact", F.col("Revenue").cast(MONEY))
    ranked = running_sum(totals, [F.desc("Revenue"), F.col(key)], {"_upto": "_exact"})
    whole = ranked.agg(F.sum("_exact").cast("double")).scalar()
    share = ratio(F.col("Revenue"), whole) * 100
    upto = ratio(F.col("_upto").cast("double"), whole) * 100
    label = F.when(upto <= ABC_CUTS[0], "A").when(upto <= ABC_CUTS[1], "B").otherwise("C")
    return ranked.select(
        key, "Revenue", "Quantity", share.alias("Revenue_Pct"), upto.alias("Cumulative_Pct"),
        label.alias("ABC_Class"),
    )


def class_counts(abc: DataFrame) -> DataFrame:
    return value_counts(abc, "ABC_Class")


def abc_table(abc: DataFrame) -> DataFrame:
    """ABC classes as display texts."""
    return abc.select(
        F.col("product_category").alias("Category"),
        F.concat(F.lit("$"), F.format_number("Revenue", 0)).alias("Revenue ($)"),
        percent(F.col("Revenue_Pct")).alias("Revenue Share (%)"),
        percent(F.col("Cumulative_Pct")).alias("Cumulative (%)"),
        F.col("ABC_Class").alias("Class"),
    )


def stock_levels(
    df: DataFrame,
    lead_time_days: float = 3,
    service_z: float = 1.65,
    order_cost: float = ORDER_COST,
    holding_rate: float = HOLDING_RATE,
) -> DataFrame:
    """Daily demand, safety stock, reorder point and economic order quantity per category."""
    demand = daily_spread(df, "product_category").select(
        "product_category",
        F.col("mean_units").alias("avg_daily_demand"),
        F.coalesce("std_units", F.lit(0.0)).alias("std_daily_demand"),
        F.col("revenue").alias("total_revenue"),
    )
    mean, std = F.col("avg_daily_demand"), F.col("std_daily_demand")
    stocked = demand.withColumn("safety_stock", half_even(service_z * std * math.sqrt(lead_time_days), 1))
    return stocked.withColumns(
        {
            "reorder_point": half_even(mean * lead_time_days + F.col("safety_stock"), 1),
            "eoq": half_even(F.sqrt(2 * mean * order_cost / holding_rate)),
        }
    )


def inventory_metrics(df: DataFrame, lead_time_days: float = 3, service_z: float = 1.65) -> DataFrame:
    """Stock levels plus days of supply and stock-out risk (variation in percent)."""
    levels = stock_levels(df, lead_time_days, service_z)
    mean = F.col("avg_daily_demand")
    risk = F.col("stockout_risk_pct")
    medium, high = RISK_CUTS
    return levels.withColumns(
        {
            "days_of_supply": F.coalesce(half_even(ratio(F.col("reorder_point"), mean), 1), F.lit(0.0)),
            "stockout_risk_pct": half_even(ratio(F.col("std_daily_demand"), mean, 0.0) * 100, 1),
        }
    ).withColumn("risk_label", F.when(risk > high, "High").when(risk > medium, "Medium").otherwise("Low"))


def inventory_kpis(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.sum("safety_stock").alias("total_safety_stock"),
        F.avg("reorder_point").alias("avg_reorder_point"),
        F.count_if(F.col("risk_label") == "High").alias("high_risk_categories"),
    )


def store_supply(df: DataFrame) -> DataFrame:
    """Daily units, their deviation, total units, revenue and inventory turnover per store."""
    stores = daily_spread(df, "store_location").select(
        "store_location",
        F.col("mean_units").alias("avg_daily_units"),
        F.coalesce("std_units", F.lit(0.0)).alias("demand_variability"),
        "total_units",
        "revenue",
    )
    return stores.withColumn(
        "inventory_turnover", half_even(F.col("total_units") / (F.col("avg_daily_units") * 7 + 1), 1)
    )


def supply_chain(df: DataFrame, ops: DataFrame) -> DataFrame:
    """Store supply numbers joined with measured operations, and the efficiency score.

    ``ops``: one row per store with ``fill_rate``, ``avg_lead_time_days``, ``on_time_delivery``.
    """
    joined = store_supply(df).join(ops, "store_location", "left")
    steadiness = 1 - F.least(
        F.greatest(F.col("demand_variability") / (F.col("avg_daily_units") + 1), F.lit(0.0)), F.lit(1.0)
    )
    score = F.col("fill_rate") * 40 + F.col("on_time_delivery") * 40 + steadiness * 20
    return joined.withColumn("efficiency_score", half_even(score, 1))


def supply_table(scored: DataFrame) -> DataFrame:
    """Supply-chain summary as display texts."""

    def share(column: str) -> Column:
        return F.concat(half_even(F.col(column) * 100, 1).cast("string"), F.lit("%"))

    return scored.select(
        F.col("store_location").alias("Store"),
        share("fill_rate").alias("Fill Rate"),
        F.col("avg_lead_time_days").alias("Avg Lead Time (days)"),
        share("on_time_delivery").alias("On-Time Delivery"),
        F.col("inventory_turnover").alias("Inventory Turnover"),
        F.col("efficiency_score").alias("Efficiency Score"),
    )


def demand_trend(df: DataFrame) -> DataFrame:
    """Per category: mean, deviation and number of selling days, means of the first and last
    seven selling days, and the daily trend between them (0 with fewer than 14 days).

    The window runs over one row per category and day, so its groups are bounded by the
    number of days, however many transactions a category has.
    """
    daily = known(df, "product_category").groupBy("product_category", "date").agg(
        units().alias("transaction_qty")
    )
    days = W.partitionBy("product_category")
    ranked = daily.select(
        "*",
        F.row_number().over(days.orderBy("date")).alias("_nth"),
        F.count(F.lit(1)).over(days).alias("_days"),
    )
    units_ = F.col("transaction_qty")
    stats = ranked.groupBy("product_category").agg(
        F.avg(units_).alias("mean_d"),
        spread(units_).alias("std_d"),
        F.avg(F.when(F.col("_nth") <= 7, units_)).alias("first7"),
        F.avg(F.when(F.col("_nth") > F.col("_days") - 7, units_)).alias("last7"),
        F.count(F.lit(1)).alias("count"),
    )
    trend = F.when(F.col("count") >= 14, (F.col("last7") - F.col("first7")) / 7).otherwise(0.0)
    return stats.withColumn("trend", trend)


def category_forecast(df: DataFrame, horizon_days: int = 14) -> DataFrame:
    """Units per category and coming day with bounds; categories with under 7 days are left out."""
    stats = demand_trend(df).where(F.col("count") >= 7)
    days = stats.withColumn("forecast_day", F.explode(F.sequence(F.lit(1), F.lit(horizon_days))))
    base = F.col("mean_d") + F.col("trend") * F.col("forecast_day")
    band = BAND_Z * F.col("std_d")
    zero = F.lit(0.0)
    return days.select(
        "product_category",
        "forecast_day",
        half_even(F.greatest(zero, base), 1).alias("forecast_units"),
        half_even(F.greatest(zero, base - band), 1).alias("lower_bound"),
        half_even(base + band, 1).alias("upper_bound"),
    )


def order_proposals(forecast: DataFrame) -> DataFrame:
    """Add the recommended order and the urgency, both from the rounded forecast."""
    expected, lower = F.col("forecast_units"), F.col("lower_bound")
    return forecast.withColumns(
        {
            "recommended_order": half_even(F.col("upper_bound") * ORDER_BUFFER),
            "urgency": F.when(expected > lower * 1.5, "High").when(expected > lower, "Medium").otherwise("Low"),
        }
    )


def order_summary(proposals: DataFrame) -> DataFrame:
    return (
        proposals.groupBy(F.col("product_category").alias("Category"))
        .agg(
            F.sum("forecast_units").alias("Total Forecast (units)"),
            F.sum("recommended_order").alias("Recommended Order"),
            F.count_if(F.col("urgency") == "High").alias("High-Urgency Days"),
        )
        .orderBy(F.desc("Total Forecast (units)"), "Category")
    )

"""Staffing needs. Everything after the first aggregation works on one row per store and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import units
from ..functions.numeric import half_even
from ..functions.ordered import arg_best
from ..schema import SHIFT_CUTS, SHIFTS, UNITS_PER_STAFF
from .kpi import known, weekday_units


def store_hour_staff(df: DataFrame) -> DataFrame:
    """Units per store and hour of day ("Transactions" are units, over the whole history) and
    the staff they need at the usual rate."""
    slots = known(df, "store_location").groupBy("store_location", "hour").agg(units().alias("Transactions"))
    return slots.withColumn("Required_Staff", F.ceil(F.col("Transactions") / UNITS_PER_STAFF).cast("double"))


def staff_plan(df: DataFrame, per_staff: float = UNITS_PER_STAFF) -> DataFrame:
    """The same with a chosen number of units per staff member, as a whole number."""
    slots = store_hour_staff(df)
    return slots.select("store_location", "hour", "Transactions",
                        F.ceil(F.col("Transactions") / per_staff).alias("Required Staff"))


def staff_kpis(plan: DataFrame) -> DataFrame:
    """One row: staff hours, peak and mean staff, and the slot with the peak."""
    peak = arg_best(plan, "Required Staff", "store_location", "hour")
    slot = peak.select(F.struct("store_location", "hour")).scalar()
    return plan.agg(
        F.sum("Required Staff").alias("total_staff_hours"),
        F.max("Required Staff").alias("peak_staff"),
        half_even(F.avg("Required Staff"), 1).alias("avg_staff"),
    ).select(
        "*",
        slot.getField("store_location").alias("peak_store"),
        slot.getField("hour").alias("peak_hour"),
    )


def staff_by(plan: DataFrame, key: str) -> DataFrame:
    """Staff per hour or per store."""
    return plan.groupBy(key).agg(F.sum("Required Staff").alias("Required Staff"))


def busiest(plan: DataFrame, key: str) -> DataFrame:
    return arg_best(staff_by(plan, key), "Required Staff", key)


def weekly_staff(df: DataFrame, per_staff: float = UNITS_PER_STAFF) -> DataFrame:
    """Staff per weekday, the weekly average, and whether the day lies above it."""
    days = weekday_units(df).select(
        "weekday_num", "weekday", F.col("Transactions").alias("transaction_qty"),
        F.ceil(F.col("Transactions") / per_staff).alias("Required Staff"),
    )
    average = days.agg(F.avg("Required Staff")).scalar()
    return (
        days.withColumn("average", average)
        .withColumn("above_average", F.col("Required Staff") > F.col("average"))
        .orderBy("weekday_num")
    )


def shift_plan(plan: DataFrame) -> DataFrame:
    """Staff per hour with its shift: by thirds of the busiest hour; no staff, no shift."""
    hourly = staff_by(plan, "hour")
    peak = hourly.agg(F.max("Required Staff").cast("double")).scalar()
    staff = F.col("Required Staff")
    skeleton, standard, full = (F.lit(s) for s in SHIFTS)
    shift = (
        F.when(staff <= 0, None)
        .when(staff <= peak * SHIFT_CUTS[0], skeleton)
        .when(staff <= peak * SHIFT_CUTS[1], standard)
        .otherwise(full)
    )
    return hourly.withColumn("Shift", shift)


def store_staff_range(plan: DataFrame) -> DataFrame:
    """Mean and peak staff per store."""
    return plan.groupBy(F.col("store_location").alias("Store")).agg(
        F.avg("Required Staff").alias("Avg Staff"), F.max("Required Staff").alias("Peak Staff")
    )

"""Windowed numbers over a stream of enriched transactions, and their static baselines.

Every operator also runs on a batch frame. State is one row per open window and key: copies of
a hot key are combined before the shuffle, and the watermark bounds how many windows stay open.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import revenue, rows, units
from ..functions.numeric import money_total, ratio, total
from ..operators.kpi import known
from ..schema import Z_EPSILON
from ..sources.sinks import write_table
from .ingest import marked

def _windows(df: DataFrame, size: str, slide: str | None, *keys: str) -> DataFrame:
    """Sums per window and key; a stream keeps the watermark it has. Unknown keys are no group."""
    window = F.window("transaction_time", size, slide) if slide else F.window("transaction_time", size)
    sums = marked(known(df, *keys)).groupBy(window, *keys).agg(
        units().alias("units"), revenue().alias("revenue"), rows(df).alias("transactions")
    )
    return sums.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys,
        "units", "revenue", "transactions",
    )


def hourly_by_store(df: DataFrame) -> DataFrame:
    """Units, revenue and transactions per store and full hour."""
    return _windows(df, "1 hour", None, "store_location")


def rolling_windows(df: DataFrame, minutes: int = 60, slide: int = 15) -> DataFrame:
    """Revenue, transactions and average order of sliding windows.

    Rows are first summed up in panes that every window is made of, so a row is counted once however long and
    close the windows are; only panes are repeated for each window they lie in.
    """
    pane = math.gcd(minutes, slide)
    marked_rows = marked(df)
    panes = marked_rows.groupBy(F.window("transaction_time", f"{pane} minutes").alias("pane")).agg(
        units().alias("units"), revenue().alias("revenue"), rows(df).alias("transactions")
    )
    window = F.window(F.window_time("pane"), f"{minutes} minutes", f"{slide} minutes")
    sums = panes.groupBy(window).agg(
        total("units").alias("units"), money_total("revenue").alias("revenue"), F.sum("transactions").alias("transactions")
    )
    sums = sums.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "units", "revenue", "transactions")
    return sums.withColumn("avg_order", ratio(F.col("revenue"), F.col("transactions"), 0.0))


def hour_baseline(df: DataFrame, before: str | None = None) -> DataFrame:
    """Per hour of day, over the days before a date: mean revenue, mean and deviation of the units.

    At most 24 rows, which is why joins may broadcast it. Hours without sales do not count. The
    days that are scored should not be in it.
    """
    past = df if before is None else df.where(F.col("date") < F.lit(before).cast("date"))
    hourly = past.groupBy("date", "hour").agg(units().alias("units"), revenue().alias("revenue"))
    return hourly.groupBy("hour").agg(
        F.avg("revenue").alias("base_revenue"),
        F.avg("units").alias("mean_units"),
        F.stddev_samp("units").alias("std_units"),
    )


def store_baseline(df: DataFrame, path: str, before: str | None = None) -> DataFrame:
    """The baseline as a table of its own, so that a stream does not read the history again for
    each batch. Write it anew, and start the stream anew, once a day."""
    return write_table(hour_baseline(df, before).coalesce(1), path)


def rolling_vs_baseline(df: DataFrame, baseline: DataFrame, minutes: int = 60, slide: int = 15) -> DataFrame:
    """Sliding revenue next to what the hour of its start usually brings in the same time."""
    windows = rolling_windows(df, minutes, slide).withColumn("hour", F.hour("window_start"))
    usual = F.broadcast(baseline.select("hour", "base_revenue"))
    joined = windows.join(usual, "hour", "left")
    expected = F.col("base_revenue") * (minutes / 60)
    return joined.select(
        "window_start", "window_end", "hour", "revenue", expected.alias("baseline_revenue"),
        ratio(F.col("revenue"), expected).alias("vs_baseline"),
    )


def window_anomalies(df: DataFrame, baseline: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Hourly units scored against the same hour of the past days."""
    hours = _windows(df, "1 hour", None).withColumn("hour", F.hour("window_start"))
    joined = hours.join(F.broadcast(baseline), "hour", "left")
    score = (F.col("units") - F.col("mean_units")) / (F.col("std_units") + Z_EPSILON)
    return joined.select("window_start", "hour", "units", score.alias("z_score")).withColumn(
        "is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False))
    )


def live_store_revenue(df: DataFrame) -> DataFrame:
    """Revenue per store since the start of the stream; for complete mode. One row of state per store."""
    return known(df, "store_location").groupBy("store_location").agg(revenue().alias("revenue"))

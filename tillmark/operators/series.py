"""Time series and forecasts for all series of a table in one job.

A series is the whole table ("All Stores") or one per store, or per store and category. After
the first aggregation a series has one row per hour or day, so whatever is partitioned by
series below is bounded by the length of the calendar, not by the number of transactions.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fits import arima_212, arima_forecast_with, seasonal_fit
from ..functions.measures import MEASURES, rows
from ..functions.numeric import money_total, ratio
from ..functions.ordered import arg_best
from ..functions.text import clock_text, minute_text, money
from ..session import durable
from .kpi import known
from .shape import stack

# Ship the fitting closures with the task, so executors do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALL = "All Stores"
MAX_GAP_DAYS = 3660
STEPS = {"hour": "1 hour", "day": "1 day"}


def series_key(by: Sequence[str]) -> Column:
    """Name of a series. Slashes in the parts of a longer key are doubled, so names stay unique."""
    if len(by) < 2:
        return F.col(by[0]) if by else F.lit(ALL)
    return F.concat_ws(" / ", *[F.replace(F.col(c), F.lit("/"), F.lit("//")) for c in by])


def bucket_sums(df: DataFrame, target: str, freq: str, by: Sequence[str] = ()) -> DataFrame:
    """``series_key, ds, y`` for every bucket that has sales. Names are built after the sums."""
    timed = known(df, *by).where(F.col("transaction_time").isNotNull())
    sums = timed.groupBy(*by, F.date_trunc(freq, "transaction_time").alias("ds")).agg(
        MEASURES[target]().alias("y")
    )
    return sums.select(series_key(by).alias("series_key"), "ds", "y")


def hour_sums(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Transactions folded to one row per hour (and key), durable: all series operators accept
    it in place of the transactions, so that several of them share one pass over the facts."""
    known_rows = known(df, *by).where(F.col("transaction_time").isNotNull())
    hour = F.date_trunc("hour", "transaction_time").alias("transaction_time")
    return durable(
        known_rows.groupBy(*by, hour).agg(
            MEASURES["revenue"]().alias("revenue"),
            MEASURES["transaction_qty"]().alias("transaction_qty"),
            rows(df).alias("row_count"),
        )
    )


def resample(df: DataFrame, target: str = "revenue", freq: str = "hour", by: Sequence[str] = ()) -> DataFrame:
    """The same with a 0 for every bucket between first and last sale that has none.

    Each bucket row is expanded up to the next one, so the calendar needs no join. A gap of more
    than ``MAX_GAP_DAYS`` between two sales is an error: it comes from a wrong date, and would be filled in one row.
    """
    step = F.expr(f"INTERVAL {STEPS[freq]}")
    following = F.lead("ds").over(W.partitionBy("series_key").orderBy("ds"))
    wide = F.datediff(following, F.col("ds")) > MAX_GAP_DAYS
    message = F.concat(F.lit("years without sales after "), F.col("ds").cast("string"))
    until = F.when(wide, F.raise_error(message).cast("timestamp")).otherwise(F.coalesce(following - step, F.col("ds")))
    sums = bucket_sums(df, target, freq, by).withColumn("_until", until)
    filled = sums.select(
        "series_key", "ds", "y", F.explode(F.sequence("ds", "_until", step)).alias("_slot")
    )
    return filled.select(
        "series_key",
        F.col("_slot").alias("ds"),
        F.when(F.col("_slot") == F.col("ds"), F.col("y")).otherwise(0.0).alias("y"),
    )


def moving_average(
    df: DataFrame, target: str = "revenue", by: Sequence[str] = (), periods: int = 12, window: int = 3
) -> DataFrame:
    """Flat hourly forecast: the mean of the last ``window`` hours, hours without sales being 0.

    Missing hours add nothing to a sum, so no calendar is filled for this. Series that span
    fewer than ``window`` hours give no rows.
    """
    whole = W.partitionBy("series_key")
    sums = bucket_sums(df, target, "hour", by).select(
        "*", F.max("ds").over(whole).alias("_last"), F.min("ds").over(whole).alias("_first")
    )
    hour = F.expr("INTERVAL 1 hour")
    hours = F.unix_timestamp("_last") - F.unix_timestamp("_first")
    tail = sums.where((F.col("ds") > F.col("_last") - hour * window) & (hours >= (window - 1) * 3600))
    level = tail.groupBy("series_key", "_last").agg((money_total("y") / window).alias("yhat"))
    future = F.sequence(F.col("_last") + hour, F.col("_last") + hour * periods, hour)
    return level.select("series_key", F.explode(future).alias("ds"), "yhat")


def moving_average_kpis(
    df: DataFrame, target: str = "revenue", periods: int = 12, window: int = 3
) -> DataFrame:
    """One row for the whole table: forecast total, peak hour so far, expected orders."""
    hours = hour_sums(df)
    forecast = moving_average(hours, target, (), periods, window)
    peak = arg_best(resample(hours, target), "y", "ds").select(clock_text(F.col("ds"))).scalar()
    total = forecast.agg(money_total("yhat").alias("forecast_total")).withColumn("peak_hour", peak)
    if target != "revenue":
        return total.withColumn("forecast_orders", F.col("forecast_total").cast("long"))
    order = hours.agg(ratio(money_total("revenue"), F.sum("row_count"), 0.0)).scalar()
    orders = F.col("forecast_total") / F.greatest(order, F.lit(1.0))
    return total.withColumn("forecast_orders", orders.cast("long"))


def forecast_by_hour(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy(F.hour("ds").alias("hour")).agg(money_total("yhat").alias("yhat"))


def forecast_table(forecast: DataFrame, target: str = "revenue") -> DataFrame:
    """Forecast as display texts."""
    value = money(F.col("yhat"), 2) if target == "revenue" else F.format_number("yhat", 0)
    return forecast.select(minute_text(F.col("ds")).alias("DateTime"), value.alias("Forecasted Value"))


# --- fitted forecasts: one small least-squares fit per daily series -------------------------


def _positive(df: DataFrame, target: str, freq: str, by: Sequence[str], minimum: int) -> DataFrame:
    """Series without empty buckets, of those series that have enough buckets.

    The number of partitions is given, or the small rows would be merged into a few tasks
    by size, and the fits, which cost time rather than bytes, would wait for each other. The
    window and the grouped fit both use this one partitioning.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucket_sums(df, target, freq, by).where(F.col("y") > 0).repartition(tasks, "series_key")
    counted = rows.withColumn("_buckets", F.count(F.lit(1)).over(W.partitionBy("series_key")))
    return counted.where(F.col("_buckets") >= minimum).drop("_buckets")


def seasonal_forecast(
    df: DataFrame,
    target: str = "revenue",
    by: Sequence[str] = (),
    periods: int = 30,
    z: float = 1.96,
    freq: str = "day",
) -> DataFrame:
    """``series_key, ds, yhat, yhat_lower, yhat_upper`` over the history and ``periods`` buckets.

    A linear trend with hinges times one plus the seasons: yearly, weekly and, by the hour, daily
    ones. The default band is 95 %; it takes changes of the slope to come into account. Series with fewer than 7 buckets are left out. One series is
    one task, which its number of days (or hours) bounds.
    """
    step = pd.Timedelta(days=1) if freq == "day" else pd.Timedelta(hours=1)

    def fit(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("ds")
        future = pd.date_range(series["ds"].iloc[-1] + step, periods=periods, freq=step)
        ds = pd.DatetimeIndex([*series["ds"], *future])
        days = ds.to_numpy("datetime64[s]").astype("int64") / 86_400
        n = len(series)
        bands = seasonal_fit(days[:n], series["y"].to_numpy(float), days[n:], z, freq == "hour")
        return pd.DataFrame(
            {
                "series_key": series["series_key"].iloc[0],
                "ds": ds,
                "yhat": bands[:, 0],
                "yhat_lower": bands[:, 1],
                "yhat_upper": bands[:, 2],
                "is_future": np.arange(len(ds)) >= n,
            }
        )

    schema = (
        "series_key string, ds timestamp, yhat double, yhat_lower double, yhat_upper double, is_future boolean"
    )
    return _positive(df, target, freq, by, 7).groupBy("series_key").applyInPandas(fit, schema)


def future_only(forecast: DataFrame) -> DataFrame:
    return forecast.where("is_future").drop("is_future")


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Total and mean of the forecast values per series."""
    return forecast.groupBy("series_key").agg(
        F.sum("yhat").alias("forecast_total"), F.avg("yhat").alias("daily_mean")
    )


def arima_forecast(
    df: DataFrame, target: str = "revenue", by: Sequence[str] = (), periods: int = 14, z: float = 1.96
) -> DataFrame:
    """``series_key, ds, yhat, yhat_lower, yhat_upper`` for the coming days; series under 14 days are left out."""

    def fit(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("ds")
        last = series["ds"].iloc[-1]
        level, deviation = arima_212(series["y"].to_numpy(float), periods)
        return pd.DataFrame(
            {
                "series_key": series["series_key"].iloc[0],
                "ds": pd.date_range(last + pd.Timedelta(days=1), periods=periods, freq="D"),
                "yhat": level,
                "yhat_lower": level - z * deviation,
                "yhat_upper": level + z * deviation,
            }
        )

    schema = "series_key string, ds timestamp, yhat double, yhat_lower double, yhat_upper double"
    return _positive(df, target, "day", by, 14).groupBy("series_key").applyInPandas(fit, schema)


def arima_replay(
    df: DataFrame, ar: Sequence[float], ma: Sequence[float], target: str = "revenue", by: Sequence[str] = (), periods: int = 14
) -> DataFrame:
    """``series_key, step, yhat, deviation, likelihood``: forecasts with given coefficients, say those of an earlier fit,
    their standard deviations, and the log likelihood of the series."""

    def replay(series: pd.DataFrame) -> pd.DataFrame:
        y = series.sort_values("ds")["y"].to_numpy(float)
        level, deviation, likelihood = arima_forecast_with(y, np.array(ar, float), np.array(ma, float), periods)
        return pd.DataFrame(
            {
                "series_key": series["series_key"].iloc[0], "step": np.arange(1, periods + 1), "yhat": level,
                "deviation": deviation, "likelihood": likelihood,
            }
        )

    schema = "series_key string, step long, yhat double, deviation double, likelihood double"
    return _positive(df, target, "day", by, 14).groupBy("series_key").applyInPandas(replay, schema)


def comparison(forecasts: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """Totals of forecasts (model, horizon, frame) per series, below each other."""
    return stack(
        [
            forecast.groupBy("series_key")
            .agg(F.sum("yhat").alias("Forecast Total"))
            .select("series_key", F.lit(name).alias("Model"), "Forecast Total", F.lit(horizon).alias("Horizon"))
            for name, horizon, forecast in forecasts
        ]
    )


def compare_forecasts(
    df: DataFrame,
    target: str = "revenue",
    by: Sequence[str] = (),
    hours: int = 12,
    seasonal_days: int = 30,
    arima_days: int = 14,
) -> DataFrame:
    """Forecast totals of the three models, from one pass over the facts."""
    df = hour_sums(df, by)
    return comparison(
        [
            ("Moving Average", f"{hours}h", moving_average(df, target, by, hours)),
            ("Seasonal Trend", f"{seasonal_days}d", future_only(seasonal_forecast(df, target, by, seasonal_days))),
            ("ARIMA", f"{arima_days}d", arima_forecast(df, target, by, arima_days)),
        ]
    )

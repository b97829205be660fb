"""Unusual hours of the day, by z-score of their units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import units
from ..schema import Z_EPSILON


def z_scores(df: DataFrame, value: str, threshold: float = 2.5) -> DataFrame:
    """Add the z-score of ``value`` against all rows, and the flag for large ones.

    Mean and deviation are one scalar subquery over the same frame; with a single row the
    deviation, and so the score, is null and nothing is flagged.
    """
    stats = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))).scalar()
    score = (F.col(value) - stats.getField("mean")) / (stats.getField("std") + Z_EPSILON)
    return df.withColumn("z_score", score).withColumn(
        "is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False))
    )


def hourly_anomalies(df: DataFrame, threshold: float = 2.5) -> DataFrame:
    hourly = df.groupBy("hour").agg(units().alias("transaction_qty"))
    return z_scores(hourly, "transaction_qty", threshold)


def anomaly_counts(scored: DataFrame) -> DataFrame:
    """One row: numbers of normal and unusual hours, and the sorted unusual hours (at most 24)."""
    return scored.agg(
        F.count_if(~F.col("is_anomaly")).alias("normal_hours"),
        F.count_if("is_anomaly").alias("anomalous_hours"),
        F.concat_ws(
            ", ",
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("is_anomaly"), F.col("hour")))),
                lambda h: F.concat(h.cast("string"), F.lit(":00")),
            ),
        ).alias("hours"),
    )

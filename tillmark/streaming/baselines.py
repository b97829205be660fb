"""A baseline that moves with the stream: every window is scored by the days before its own.

Windows reach ``foreachBatch`` once they are closed. Each batch scores its windows, then merges the hours it closed into the
baseline: per hour of day the number of days, mean and squared deviations of the units, mean revenue. That
table of at most 24 rows is stored with the batch's number, next to the scored windows. A batch that is repeated after a
failure starts from the table of the batch before it and overwrites its own results, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import ratio
from ..schema import Z_EPSILON
from .sinks import finished_batches, per_batch, write_batch
from .windows import _windows, rolling_windows

STATE = "hour int, days long, mean_units double, squares double, mean_revenue double"
_SUMS = ["days", "mean_units", "squares", "mean_revenue"]


def _sums() -> list[Column]:
    """What some days of an hour add up to."""
    days = F.count(F.lit(1))
    return [
        days.alias("days"), F.avg("units").alias("mean_units"), (F.var_pop("units") * days).alias("squares"),
        F.avg("revenue").alias("mean_revenue"),
    ]


def _both(one: str, other: str) -> list[Column]:
    """Two such sums as one; either may be missing."""
    a, b = ({c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0)) for c in _SUMS} for side in (one, other))
    days = a["days"] + b["days"]
    share = F.when(days > 0, b["days"] / days).otherwise(F.lit(0.0))
    gap = b["mean_units"] - a["mean_units"]
    return [
        days.alias("days"),
        (a["mean_units"] + gap * share).alias("mean_units"),
        (a["squares"] + b["squares"] + gap * gap * a["days"] * share).alias("squares"),
        (a["mean_revenue"] + (b["mean_revenue"] - a["mean_revenue"]) * share).alias("mean_revenue"),
    ]


def merged(state: DataFrame, hours: DataFrame) -> DataFrame:
    """The baseline with closed hours (``date, hour, units, revenue``) added."""
    new = hours.groupBy("hour").agg(*_sums())
    joined = state.alias("a").join(new.alias("b"), F.col("a.hour") == F.col("b.hour"), "full_outer")
    return joined.select(F.coalesce("a.hour", "b.hour").alias("hour"), *_both("a", "b"))


def before(state: DataFrame, hours: DataFrame, asked: DataFrame) -> DataFrame:
    """The baseline of each ``date, hour`` asked for: the stored one and earlier days among the closed hours.

    A batch closes few hours, so these tables are small."""
    earlier = asked.select("date", "hour").distinct().join(hours.withColumnRenamed("date", "day"), "hour").where("day < date")
    earlier = earlier.groupBy("date", "hour").agg(*_sums())
    joined = asked.select("date", "hour").distinct().alias("q").join(state.alias("a"), F.col("q.hour") == F.col("a.hour"), "left")
    joined = joined.join(earlier.alias("b"), (F.col("q.date") == F.col("b.date")) & (F.col("q.hour") == F.col("b.hour")), "left")
    return joined.select("q.date", "q.hour", *_both("a", "b"))


def _hours(windows: DataFrame) -> DataFrame:
    start = F.col("window_start")
    return windows.select(F.to_date(start).alias("date"), F.hour(start).alias("hour"), "units", "revenue")


def score_hours(hours: DataFrame, usual: DataFrame, threshold: float) -> DataFrame:
    """Units of hours against those of the same hour on earlier days."""
    spread = F.when(F.col("days") > 1, F.sqrt(F.col("squares") / (F.col("days") - 1)))
    mean = F.when(F.col("days") > 0, F.col("mean_units"))
    z = (F.col("units") - mean) / (spread + Z_EPSILON)
    start = F.make_timestamp_ntz(F.year("date"), F.month("date"), F.day("date"), F.col("hour"), F.lit(0), F.lit(0)).cast("timestamp")
    joined = hours.join(usual, ["date", "hour"], "left").select(
        start.alias("window_start"), "hour", "units", F.coalesce("days", F.lit(0)).alias("days"), z.alias("z_score")
    )
    return joined.withColumn("is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False)))


def score_windows(windows: DataFrame, usual: DataFrame, minutes: int) -> DataFrame:
    """Revenue of windows next to what the hour of their start brought on earlier days in the same time."""
    named = windows.withColumns({"date": F.to_date("window_start"), "hour": F.hour("window_start")})
    expected = F.when(F.col("days") > 0, F.col("mean_revenue")) * (minutes / 60)
    joined = named.join(usual, ["date", "hour"], "left")
    return joined.select(
        "window_start", "window_end", "hour", "revenue", F.coalesce("days", F.lit(0)).alias("days"), expected.alias("baseline_revenue"),
        ratio(F.col("revenue"), expected).alias("vs_baseline"),
    )


def baseline(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The baseline after a batch (default: the last finished one); empty before the first."""
    done = finished_batches(spark, f"{path}/baseline")
    number = max(done, default=-1) if number is None else number
    return spark.read.schema(STATE).parquet(f"{path}/baseline/batch={number}") if number in done else spark.createDataFrame([], STATE)


def _kept(path: str, batch: DataFrame, number: int, closed: DataFrame, scored: DataFrame) -> None:
    spark = batch.sparkSession
    write_batch(scored, f"{path}/scored", number)
    write_batch(merged(baseline(spark, path, number - 1), closed).coalesce(1), f"{path}/baseline", number, keep=2)


def score_anomalies(stream: DataFrame, path: str, threshold: float = 2.5, trigger: dict | None = None) -> StreamingQuery:
    """Score each closed hour of a stream by the same hour of the days before; ``read_scored`` has the results."""

    def write(batch: DataFrame, number: int) -> None:
        closed = _hours(batch.persist())
        usual = before(baseline(batch.sparkSession, path, number - 1), closed, closed)
        _kept(path, batch, number, closed, score_hours(closed, usual, threshold))
        batch.unpersist()

    return per_batch(_windows(stream, "1 hour", None), path, "append", write, trigger)


def score_rolling(stream: DataFrame, path: str, minutes: int = 60, slide: int = 15, trigger: dict | None = None) -> StreamingQuery:
    """Compare the revenue of sliding windows with that of their hour on the days before, as it has come in so far."""
    hours = _windows(stream, "1 hour", None).withColumn("_hour", F.lit(True))
    rolling = rolling_windows(stream, minutes, slide).drop("avg_order").withColumn("_hour", F.lit(False))

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        closed, windows = _hours(kept.where("_hour")), kept.where("not _hour")
        usual = before(baseline(batch.sparkSession, path, number - 1), closed, _hours(windows))
        _kept(path, batch, number, closed, score_windows(windows, usual, minutes))
        kept.unpersist()

    return per_batch(hours.unionByName(rolling), path, "append", write, trigger)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """The scored windows of all finished batches."""
    done = finished_batches(spark, f"{path}/scored")
    if not done:
        raise FileNotFoundError(f"nothing scored yet below {path}")
    return spark.read.parquet(*[f"{path}/scored/batch={n}" for n in done])

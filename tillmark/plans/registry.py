"""All registered queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import arg_best
from ..operators.clean import clean
from ..operators.enrich import enrich
from ..operators.kpi import hourly_demand
from ..sources.adapters import event_transactions
from . import aggregates, forecasts, ingest, models, planning, streams

FAMILIES = [ingest, aggregates, planning, forecasts, models, streams]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Clean, enrich, sum by hour of day, and mark the peak hour."""
    sales = enrich(clean(event_transactions(spark, folder)))
    hourly = hourly_demand(sales)
    peak = arg_best(hourly, "Quantity", "hour").select("hour").scalar()
    return hourly.withColumn("is_peak", F.col("hour") == peak)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for family in FAMILIES:
        part = getattr(family, attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")

"""Headline numbers of the last minutes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import revenue, rows
from ..functions.numeric import ratio
from .filters import recent
from .ranking import latest

FALLBACK_ROWS = 200


def rolling_kpis(df: DataFrame, minutes: int = 60, as_of: datetime | str | None = None) -> DataFrame:
    """One row: revenue, rows and average order of the window that ends at ``as_of``.

    With a given ``as_of`` the bounds are literals and reach the Parquet scan. If nothing
    falls into the window, the latest 200 rows are used; the default ``as_of``, the latest
    transaction, cannot have an empty window.
    """
    window = recent(df, minutes, as_of)
    found = window.agg(revenue().alias("revenue"), rows(df).alias("transactions"))
    if as_of is not None:
        last = latest(df, FALLBACK_ROWS)
        spare = last.agg(F.struct(revenue().alias("revenue"), rows(df).alias("transactions"))).scalar()
        empty = F.col("transactions") == 0
        found = found.select(
            F.when(empty, spare.getField("revenue")).otherwise(F.col("revenue")).alias("revenue"),
            F.when(empty, spare.getField("transactions")).otherwise(F.col("transactions")).alias("transactions"),
        )
    return found.select(
        "*",
        ratio(F.col("revenue"), F.col("transactions"), 0.0).alias("avg_order"),
        F.lit(minutes).alias("window"),
    )

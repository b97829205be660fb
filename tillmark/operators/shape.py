"""Grids, long tables, and stacked result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import units
from ..schema import HOURS
from .kpi import known


def _hour_columns(grid: DataFrame, keys: Sequence[str], fill: float | None) -> DataFrame:
    cells = [F.col(str(h)) if fill is None else F.coalesce(F.col(str(h)), F.lit(fill)) for h in HOURS]
    return grid.select(*keys, *[c.alias(f"h{h:02d}") for h, c in zip(HOURS, cells)])


def store_hour_grid(staff: DataFrame, value: str = "Required_Staff") -> DataFrame:
    """One row per store, one column per hour, 0 where a store has no sales in an hour.

    The hours are given, so no extra job looks for them.
    """
    grid = known(staff, "store_location").groupBy("store_location").pivot("hour", HOURS)
    return _hour_columns(grid.agg(F.sum(F.col(value).cast("double"))), ["store_location"], 0.0)


def weekday_hour_grid(df: DataFrame) -> DataFrame:
    """One row per weekday, Monday first, one column per hour, null where nothing was sold."""
    grid = df.groupBy("weekday_num", "weekday").pivot("hour", HOURS).agg(units())
    return _hour_columns(grid, ["weekday_num", "weekday"], None).orderBy("weekday_num")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "Metric",
         value: str = "Value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames below each other, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)

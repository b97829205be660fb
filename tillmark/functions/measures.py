"""The four additive measures. They read raw rows as well as a roll-up of them.

A roll-up (see ``plans.rollup``) carries ``row_count`` and ``id_count``; raw transactions do
not. Because operators go through these helpers, every additive operator can run over either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import money_total, total


def units() -> Column:
    return total("transaction_qty")


def revenue() -> Column:
    return money_total("revenue")


def rows(df: DataFrame) -> Column:
    if "row_count" in df.columns:
        return F.coalesce(F.sum("row_count"), F.lit(0)).cast("long")
    return F.count(F.lit(1))


def ids(df: DataFrame) -> Column:
    if "id_count" in df.columns:
        return F.coalesce(F.sum("id_count"), F.lit(0)).cast("long")
    if "transaction_id" in df.columns:
        return F.count("transaction_id")
    return F.lit(None).cast("long")


MEASURES = {"revenue": revenue, "transaction_qty": units}

"""Number helpers. Every expression stays inside whole-stage code generation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exact amounts: nine decimals, totals below 1e28.
MONEY = "decimal(37,9)"

NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def half_even(value: Column, digits: int = 0) -> Column:
    """Round the scaled value half to even."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def ratio(top: Column, bottom: Column, otherwise: float | None = None) -> Column:
    """Division that gives ``otherwise`` (default null) instead of failing on zero."""
    result = F.try_divide(top, bottom)
    return result if otherwise is None else F.coalesce(result, F.lit(otherwise))


def to_number(value: Column, source_type: str) -> Column:
    """Double, or null for anything that is not a finite number."""
    if source_type == "string":
        value = F.when(value.rlike(NUMBER_TEXT), F.trim(value))
    number = value.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)  # NaN sorts above infinity


def total(value: Column | str) -> Column:
    """Sum that is 0 over no rows or only nulls."""
    return F.coalesce(F.sum(value).cast("double"), F.lit(0.0))


def money_total(value: Column | str) -> Column:
    """Sum of money amounts, 0 over no rows; exact to nine decimals, so it does not depend on the
    order in which partitions or retries add the rows. What is not a finite number does not count.

    Each amount is cut into four whole numbers, the bits of its whole part above and below 2**20
    and of its billionths above and below 2**15. They are added as 64-bit numbers within generated code;
    1e12 rows cannot overflow any (of the first, only a total beyond 9e24 can, which fails).
    """
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    value = F.when(F.abs(value) < float("inf"), value)
    whole = F.floor(value).cast("long")
    part = F.rint((value - whole) * 1e9).cast("long")

    def added(number: Column, bits: int) -> Column:
        high, low = F.shiftright(number, bits), number.bitwiseAND(F.lit(2**bits - 1).cast("long"))
        return F.sum(high).cast("decimal(20,0)") * F.lit(2**bits).cast("decimal(7,0)") + F.sum(low).cast("decimal(20,0)")

    billionths = added(part, 15).cast("decimal(28,0)") * F.lit(Decimal("1E-9"))
    return F.coalesce((added(whole, 20).cast(MONEY) + billionths.cast(MONEY)).cast("double"), F.lit(0.0))


def spread(value: Column | str) -> Column:
    """Sample standard deviation, 0 for a single row."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))

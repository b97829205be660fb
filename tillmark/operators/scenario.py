"""What-if scenarios over one row of base numbers, or one row per store.

The facts are read once for the base; scenarios and curves are array expressions on that row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import revenue, rows
from ..functions.numeric import half_even, ratio
from ..functions.text import count_text, money, percent, plain_number, signed, thousands
from ..schema import COST_SHARE
from .kpi import known


@dataclass(frozen=True)
class Scenario:
    """Changes in percent, and a number of new stores."""

    scenario_id: str = "default"
    demand_change: int = 20
    price_change: int = 10
    cost_change: int = 5
    new_stores: int = 1


def _with_base(totals: DataFrame) -> DataFrame:
    base = totals.withColumns(
        {
            "base_avg_order": ratio(F.col("base_revenue"), F.col("base_transactions"), 0.0),
            "revenue_per_store": F.col("base_revenue") / F.greatest(F.col("num_stores"), F.lit(1)),
            "cost_base": F.col("base_revenue") * COST_SHARE,
        }
    )
    return base.withColumn("base_profit", F.col("base_revenue") - F.col("cost_base"))


def scenario_base(df: DataFrame) -> DataFrame:
    """One row: revenue, rows, number of stores, and what follows from them."""
    if "store_location" not in df.columns:
        df = df.withColumn("store_location", F.lit("N/A"))
    stores = df.groupBy("store_location").agg(revenue().alias("revenue"), rows(df).alias("row_count"))
    return _with_base(
        stores.agg(
            revenue().alias("base_revenue"),
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("base_transactions"),
            F.count("store_location").alias("num_stores"),
        )
    )


def store_scenario_base(df: DataFrame) -> DataFrame:
    """The same per store, each store taken by itself."""
    stores = known(df, "store_location").groupBy("store_location").agg(
        revenue().alias("base_revenue"), rows(df).alias("base_transactions")
    )
    return _with_base(stores.withColumn("num_stores", F.lit(1)))


def _factor(change: Column) -> Column:
    return 1 + change / 100


def _revenue(demand: Column, price: Column, stores: Column) -> Column:
    grown = F.col("base_revenue") * _factor(demand) * _factor(price)
    return grown + stores * F.col("revenue_per_store") * _factor(demand)


def _cost(cost: Column, stores: Column) -> Column:
    added = F.coalesce(F.try_divide(stores * F.col("cost_base"), F.col("num_stores")), F.lit(0.0))
    return F.col("cost_base") * _factor(cost) + added


def project(base: DataFrame, scenarios: Sequence[Scenario] = (Scenario(),)) -> DataFrame:
    """Projected revenue, transactions, order value, cost and profit for every base row and
    scenario. The scenarios are an array literal on each row: nothing is joined or shuffled."""
    literal = F.array(
        *[
            F.struct(
                F.lit(s.scenario_id).alias("scenario_id"),
                F.lit(s.demand_change).alias("demand_change"),
                F.lit(s.price_change).alias("price_change"),
                F.lit(s.cost_change).alias("cost_change"),
                F.lit(s.new_stores).alias("new_stores"),
            )
            for s in scenarios
        ]
    )
    rows_ = base.select("*", F.inline(literal))
    demand, price = F.col("demand_change"), F.col("price_change")
    projected = rows_.withColumns(
        {
            "scenario_revenue": _revenue(demand, price, F.col("new_stores")),
            "scenario_transactions": F.col("base_transactions") * _factor(demand),
            "scenario_avg_order": F.col("base_avg_order") * _factor(price),
            "scenario_cost": _cost(F.col("cost_change"), F.col("new_stores")),
        }
    )
    projected = projected.withColumn("scenario_profit", F.col("scenario_revenue") - F.col("scenario_cost"))
    return projected.withColumns(
        {
            "revenue_delta": F.col("scenario_revenue") - F.col("base_revenue"),
            "profit_delta": F.col("scenario_profit") - F.col("base_profit"),
        }
    )


def store_scenarios(df: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Every scenario for every store, in one job."""
    return project(store_scenario_base(df), scenarios)


# Row titles, and the columns of baseline and scenario.
COMPARED = [
    ("Revenue", "base_revenue", "scenario_revenue"),
    ("Transactions", "base_transactions", "scenario_transactions"),
    ("Avg Order Value", "base_avg_order", "scenario_avg_order"),
    ("Profit", "base_profit", "scenario_profit"),
]


def comparison(projected: DataFrame) -> DataFrame:
    """Baseline against scenario, one row per metric, with the change in percent."""
    lines = F.array(
        *[
            F.struct(
                F.lit(title).alias("Metric"),
                F.col(base).cast("double").alias("Baseline"),
                F.col(changed).cast("double").alias("Scenario"),
            )
            for title, base, changed in COMPARED
        ]
    )
    change = ratio(F.col("Scenario") - F.col("Baseline"), F.abs("Baseline")) * 100
    return projected.select("scenario_id", F.inline(lines)).withColumn("Change (%)", half_even(change, 1))


def summary_table(projected: DataFrame) -> DataFrame:
    """Baseline against scenario as display texts, with the revenue change as last line."""
    change = ratio(F.col("revenue_delta"), F.col("base_revenue")) * 100

    def order_value(column: str) -> Column:
        return F.concat(F.lit("$"), plain_number(F.col(column), 2))

    lines = [
        ("Revenue", money(F.col("base_revenue")), money(F.col("scenario_revenue"))),
        ("Transactions", count_text(F.col("base_transactions")), count_text(F.col("scenario_transactions"))),
        ("Avg Order Value", order_value("base_avg_order"), order_value("scenario_avg_order")),
        ("Profit", money(F.col("base_profit")), money(F.col("scenario_profit"))),
        ("Change (%)", F.lit("—"), signed(percent(change), F.col("revenue_delta"))),
    ]
    table = F.array(
        *[
            F.struct(F.lit(title).alias("Metric"), base.alias("Baseline"), changed.alias("Scenario"))
            for title, base, changed in lines
        ]
    )
    return projected.select("scenario_id", F.inline(table))


def _curve(base: DataFrame, name: str, start: int, stop: int, step: int) -> DataFrame:
    points = F.sequence(F.lit(start), F.lit(stop), F.lit(step))
    return base.withColumn(name, F.explode(points))


def demand_curve(base: DataFrame, s: Scenario = Scenario()) -> DataFrame:
    """Revenue over demand changes from -50 % to 100 %."""
    points = _curve(base, "Demand Change (%)", -50, 100, 10)
    value = _revenue(F.col("Demand Change (%)"), F.lit(s.price_change), F.lit(s.new_stores))
    return points.select("Demand Change (%)", value.alias("Revenue"))


def price_curve(base: DataFrame, s: Scenario = Scenario()) -> DataFrame:
    """Revenue over price changes from -30 % to 50 %; new stores bring their base revenue."""
    points = _curve(base, "Price Change (%)", -30, 50, 5)
    grown = F.col("base_revenue") * _factor(F.lit(s.demand_change)) * _factor(F.col("Price Change (%)"))
    value = grown + F.lit(s.new_stores) * F.col("revenue_per_store")
    return points.select("Price Change (%)", value.alias("Revenue"))


def cost_curve(base: DataFrame, s: Scenario = Scenario()) -> DataFrame:
    """Profit over operating-cost changes from -20 % to 50 %."""
    points = _curve(base, "Cost Change (%)", -20, 50, 5)
    income = _revenue(F.lit(s.demand_change), F.lit(s.price_change), F.lit(s.new_stores))
    value = income - _cost(F.col("Cost Change (%)"), F.lit(s.new_stores))
    return points.select("Cost Change (%)", value.alias("Profit"))


def expansion_curve(base: DataFrame, s: Scenario = Scenario()) -> DataFrame:
    """Revenue with 0 to 5 new stores, each bringing its base revenue."""
    points = _curve(base, "New Stores", 0, 5, 1)
    grown = F.col("base_revenue") * _factor(F.lit(s.demand_change)) * _factor(F.lit(s.price_change))
    value = grown + F.col("New Stores") * F.col("revenue_per_store")
    return points.select("New Stores", value.alias("Revenue")).withColumn("label", thousands(F.col("Revenue")))

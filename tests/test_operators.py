"""Operators on small inputs with results worked out by hand."""

import pytest

from tillmark.operators import (
    anomaly, demand, filters, inventory, kpi, ranking, rolling, scenario, shape, workforce,
)
from tillmark.operators.scenario import Scenario
from tillmark.plans.common import sales
from tillmark.plans.rollup import stored_rollup
from tillmark.session import shared_path

DAY = "2024-01-{:02d} {:02d}:00:00"


def days(quantities, store="a", category="x", price=1):
    return [(DAY.format(d + 1, 10), q, price, store, category) for d, q in enumerate(quantities)]


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_unknown_store_has_no_row(sell):
    sales = sell([(DAY.format(1, 1), 2, 1, None, "x"), (DAY.format(1, 1), 1, 1, "a", "x")])
    assert rows(kpi.store_performance(sales), "store_location") == [("a",)]


def test_equal_revenue_first_key_wins(sell):
    sales = sell([(DAY.format(1, 1), 2, 1, "b", "y"), (DAY.format(1, 1), 2, 1, "a", "x")])
    got = kpi.kpis(sales).first()
    assert (got["Best_Store"], got["Best_Category"]) == ("a", "x")


def test_unknown_keys_count_in_totals_but_do_not_win(sell):
    sales = sell([(DAY.format(1, 1), 9, 1, None, None), (DAY.format(1, 1), 1, 1, "a", "x")])
    got = kpi.kpis(sales).first()
    assert (got["Revenue"], got["Transactions"], got["Best_Store"], got["Best_Category"]) == (10.0, 2, "a", "x")


def test_kpis_of_nothing(sell):
    got = kpi.kpis(sell([(DAY.format(1, 1), 1, 1, "a", "x")]).where("false")).first()
    assert (got["Revenue"], got["Transactions"], got["Avg_Order_Value"], got["Best_Store"]) == (0.0, 0, 0.0, None)


def test_missing_key_columns(sell):
    sales = sell(days([1, 2])).drop("store_location", "product_category")
    got = kpi.kpis(sales).first()
    assert (got["Best_Store"], got["Best_Category"], got["Quantity"]) == ("N/A", "N/A", 3.0)
    assert inventory.abc_classes(sales).count() == 0
    assert inventory.inventory_metrics(sales).count() == 0


def slots(spark, values):
    data = [(i // 24, "d", i % 24, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "weekday_num int, weekday string, hour int, transaction_qty double")


def levels(spark, values):
    got = demand.quartile_levels(slots(spark, values)).orderBy("weekday_num", "hour")
    return [r["Demand_Level"] for r in got.collect()]


def test_quartile_levels(spark):
    assert levels(spark, range(1, 9)) == ["Low"] * 2 + ["Medium"] * 2 + ["High"] * 2 + ["Extreme"] * 2


def test_equal_quartile_limits_give_medium(spark):
    assert levels(spark, [1, 1, 1, 1, 5]) == ["Medium"] * 5


def plan(spark, staff):
    data = [("a", h, float(s * 30), s) for h, s in enumerate(staff)]
    return spark.createDataFrame(data, "store_location string, hour int, Transactions double, `Required Staff` bigint")


def shifts(spark, staff):
    return [r["Shift"] for r in workforce.shift_plan(plan(spark, staff)).orderBy("hour").collect()]


def test_shift_limits(spark):
    got = shifts(spark, [0, 1, 33, 34, 67, 68, 100])
    assert got == [None] + ["Skeleton Crew"] * 2 + ["Standard Shift"] * 2 + ["Peak Shift"] * 2


def test_no_staff_no_shift(spark):
    assert shifts(spark, [0, 0]) == [None, None]


def test_staff_is_rounded_up(sell):
    sales = sell([(DAY.format(1, h), q, 1, "a", "x") for h, q in ((1, 0), (2, 30), (3, 31))])
    got = workforce.staff_plan(sales, 30).orderBy("hour")
    assert rows(got, "Required Staff") == [(0,), (1,), (2,)]


def abc(sell, revenues):
    sales = sell([(DAY.format(1, 1), r, 1, "a", f"c{i}") for i, r in enumerate(revenues)])
    got = inventory.abc_classes(sales).orderBy("product_category").collect()
    return [r["ABC_Class"] for r in got], [round(r["Cumulative_Pct"], 9) for r in got]


def test_abc_limits(sell):
    assert abc(sell, [70, 20, 10]) == (["A", "B", "C"], [70.0, 90.0, 100.0])
    assert abc(sell, [75, 15, 10])[0] == ["B", "B", "C"]


def test_stock_levels(sell):
    got = inventory.inventory_metrics(sell(days([10, 20, 30])), 3, 1.65).first()
    assert got["safety_stock"] == 28.6 and got["reorder_point"] == 88.6 and got["eoq"] == 100.0
    assert (got["days_of_supply"], got["stockout_risk_pct"], got["risk_label"]) == (4.4, 50.0, "High")


def test_stock_levels_of_one_day(sell):
    got = inventory.inventory_metrics(sell(days([5]))).first()
    assert (got["std_daily_demand"], got["safety_stock"], got["reorder_point"], got["eoq"]) == (0.0, 0.0, 15.0, 50.0)
    assert (got["days_of_supply"], got["stockout_risk_pct"], got["risk_label"]) == (3.0, 0.0, "Low")


def test_category_forecast_with_trend(sell):
    got = inventory.order_proposals(inventory.category_forecast(sell(days(range(1, 15))), 1)).first()
    assert (got["forecast_units"], got["lower_bound"], got["upper_bound"]) == (8.5, 1.6, 15.4)
    assert (got["recommended_order"], got["urgency"]) == (17.0, "High")


def test_category_forecast_of_constant_demand(sell):
    got = inventory.order_proposals(inventory.category_forecast(sell(days([5] * 7)), 3)).collect()
    assert len(got) == 3
    assert {(r["forecast_units"], r["lower_bound"], r["upper_bound"], r["recommended_order"], r["urgency"])
            for r in got} == {(5.0, 5.0, 5.0, 6.0, "Low")}


def test_six_days_give_no_forecast(sell):
    assert inventory.category_forecast(sell(days([1] * 6))).count() == 0


def test_supply_chain_score(spark, sell):
    ops = spark.createDataFrame(
        [("a", 0.95, 2.0, 0.90)],
        "store_location string, fill_rate double, avg_lead_time_days double, on_time_delivery double",
    )
    got = inventory.supply_chain(sell(days([10, 20, 30])), ops).first()
    assert (got["inventory_turnover"], got["efficiency_score"]) == (0.4, 84.5)
    assert inventory.supply_table(inventory.supply_chain(sell(days([1])), ops)).first()["Fill Rate"] == "95.0%"


def test_anomaly(sell):
    sales = sell([(DAY.format(1, h), 100 if h == 9 else 10, 1, "a", "x") for h in range(10)])
    got = anomaly.hourly_anomalies(sales, 2.5).orderBy("hour").collect()
    assert [r["is_anomaly"] for r in got] == [False] * 9 + [True]
    assert got[9]["z_score"] == pytest.approx(2.846, abs=1e-3)
    assert got[0]["z_score"] == pytest.approx(-0.316, abs=1e-3)
    counts = anomaly.anomaly_counts(anomaly.hourly_anomalies(sales, 2.5)).first()
    assert tuple(counts) == (9, 1, "9:00")


def test_single_hour_is_no_anomaly(sell):
    got = anomaly.hourly_anomalies(sell(days([5]))).first()
    assert got["z_score"] is None and got["is_anomaly"] is False


def base(spark):
    data = [(1000.0, 100, 2, 10.0, 500.0, 600.0, 400.0)]
    return spark.createDataFrame(
        data,
        "base_revenue double, base_transactions bigint, num_stores bigint, base_avg_order double,"
        " revenue_per_store double, cost_base double, base_profit double",
    )


def test_scenario(spark):
    got = scenario.project(base(spark)).first()
    assert got["scenario_revenue"] == pytest.approx(1920)
    assert got["scenario_cost"] == pytest.approx(930)
    assert got["scenario_profit"] == pytest.approx(990)
    assert got["base_profit"] == 400


def test_price_curve_leaves_new_stores_at_base(spark):
    got = scenario.price_curve(base(spark)).where("`Price Change (%)` = 10").first()
    assert got["Revenue"] == pytest.approx(1820)


def test_scenario_base_without_stores(spark, sell):
    empty = scenario.scenario_base(sell(days([1])).where("false"))
    got = scenario.project(empty, [Scenario()]).first()
    assert (got["scenario_revenue"], got["scenario_cost"]) == (0.0, 0.0)


def test_rolling_window_and_fallback(sell):
    sales = sell([(DAY.format(1, h), 1, h, "a", "x") for h in range(24)])
    latest = rolling.rolling_kpis(sales, 60).first()
    assert (latest["revenue"], latest["transactions"], latest["avg_order"]) == (45.0, 2, 22.5)
    given = rolling.rolling_kpis(sales, 120, "2024-01-01 10:30:00").first()
    assert (given["revenue"], given["transactions"]) == (19.0, 2)
    spare = rolling.rolling_kpis(sales, 15, "2025-01-01 00:00:00").first()
    assert (spare["transactions"], spare["revenue"]) == (24, float(sum(range(24))))


def test_histogram_and_five_numbers(spark):
    df = spark.range(0, 101).selectExpr("cast(id as double) v", "cast(id % 2 as string) g")
    assert sum(r["count"] for r in kpi.histogram(df, "v", 30).collect()) == 101
    assert tuple(kpi.five_numbers(df, "v").first()) == (0.0, 25.0, 50.0, 75.0, 100.0)
    got = {r["g"]: r["median"] for r in kpi.five_numbers(df, "v", ["g"]).collect()}
    assert got == {"0": 50.0, "1": 50.0}


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [tuple(r) for r in kpi.histogram(df, "v").collect()] == [(1, 2)]


def test_grid_fill_and_order(sell):
    sales = sell([(DAY.format(d, 9), 5, 1, "a", "x") for d in (1, 7)])
    grid = shape.store_hour_grid(workforce.store_hour_staff(sales)).first()
    assert (grid["h09"], grid["h10"]) == (1.0, 0.0)
    week = shape.weekday_hour_grid(sales).collect()
    assert [r["weekday"] for r in week] == ["Monday", "Sunday"] and week[0]["h10"] is None


def test_feed_filters_and_choices(sell):
    sales = sell(days([1, 2, 3]))
    assert rows(ranking.latest(sales, 2), "transaction_id") == [("2",), ("1",)]
    assert rows(filters.choices(sales, "store_location"), "store_location") == [("a",)]
    assert filters.among(sales, "product_category", []).count() == 3
    assert filters.among(sales, "product_category", ["none"]).count() == 0
    assert ranking.sample_rows(sales, 2).collect() == ranking.sample_rows(sales.repartition(3), 2).collect()


@pytest.mark.parametrize("operator", [
    kpi.kpis, kpi.store_performance, kpi.daily_sales, kpi.hourly_demand, kpi.hourly_mean_units, kpi.quarterly_revenue,
    workforce.store_hour_staff, demand.demand_levels, demand.pattern_kpis, inventory.inventory_metrics,
    inventory.abc_classes, inventory.category_forecast, scenario.scenario_base, anomaly.hourly_anomalies,
])
def test_rollup_gives_the_same(stored, operator):
    """Additive operators give the same rows over the stored roll-up as over the transactions."""
    facts, cube = stored
    want = operator(facts)
    assert comparable(operator(cube).select(*want.columns)) == comparable(want)


@pytest.fixture(scope="module")
def stored(spark, folder):
    facts = sales(spark, folder)
    return facts, stored_rollup(facts, shared_path(spark, "rollup"))


def comparable(df):
    """Rows in a fixed order; deviations may differ in the last bits by order of summation."""
    return sorted(
        (tuple(float(f"{v:.10g}") if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr
    )

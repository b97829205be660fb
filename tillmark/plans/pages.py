"""The reports as bundles of result frames.

``sales`` is either the enriched transactions or their roll-up (``plans.rollup``); over the
roll-up a whole page costs one small scan. Frames are lazy: what is not used is not computed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import arg_best
from ..functions.text import month_label
from ..operators import anomaly, demand, filters, inventory, kpi, learning, ranking, rolling, scenario, series, shape
from ..operators import workforce as staff
from ..session import durable

Page = dict[str, DataFrame]


def dashboard(sales: DataFrame) -> Page:
    hourly = kpi.hourly_demand(sales)
    return {
        "kpis": kpi.kpis(sales),
        "daily": kpi.daily_sales(sales).orderBy("date"),
        "stores": kpi.store_performance(sales),
        "category_share": kpi.share_of_total(kpi.category_totals(sales), "Revenue"),
        "hourly": hourly.orderBy("hour"),
        "peak_hour": arg_best(hourly, "Quantity", "hour"),
        "staff_grid": shape.store_hour_grid(staff.store_hour_staff(sales)),
    }


def executive_overview(sales: DataFrame, transactions: DataFrame) -> Page:
    """``transactions`` are the rows themselves: distinct ids cannot come from a roll-up."""
    categories = kpi.category_totals(sales)
    return {
        **dashboard(sales),
        "store_transactions": kpi.share_of_total(kpi.distinct_transactions(transactions), "transaction_id"),
        "categories": ranking.sort_desc(categories, "Revenue", "product_category"),
        "quantity_share": kpi.share_of_total(categories, "Quantity"),
        "store_table": kpi.store_table(sales),
    }


def sales_forecast(
    sales: DataFrame,
    store: str | None = None,
    target: str = "revenue",
    hours: int = 12,
    seasonal_days: int = 30,
    arima_days: int = 14,
) -> Page:
    rows = series.hour_sums(filters.for_store(sales, store))
    # Kept, since several parts of the page read them: each model is fitted once.
    flat = durable(series.moving_average(rows, target, periods=hours))
    seasonal = durable(series.seasonal_forecast(rows, target, periods=seasonal_days))
    arima = durable(series.arima_forecast(rows, target, periods=arima_days))
    forecasts = [
        ("Moving Average", f"{hours}h", flat),
        ("Seasonal Trend", f"{seasonal_days}d", series.future_only(seasonal)),
        ("ARIMA", f"{arima_days}d", arima),
    ]
    return {
        "stores": filters.choices(sales, "store_location"),
        "actual": series.resample(rows, target),
        "moving_average": flat,
        "moving_average_kpis": series.moving_average_kpis(rows, target, hours),
        "seasonal": seasonal,
        "seasonal_totals": series.forecast_totals(series.future_only(seasonal)),
        "arima": arima,
        "comparison": series.comparison(forecasts),
        "by_hour": series.forecast_by_hour(flat),
        "table": series.forecast_table(flat, target),
    }


def peak_demand(transactions: DataFrame, tune: bool = False) -> dict[str, Page]:
    """One page per model: metrics, residuals, error distribution, importance, and, when tuned,
    the scores of the grid and the best parameters, which are then also those of the cross-validation."""
    table = learning.training_table(transactions)
    grids = {"Boosted Trees": learning.BOOSTED_GRID, "Random Forest": learning.FOREST_GRID}
    pages = {}
    for name, make in learning.MODELS.items():
        page: Page = {}
        estimator = make()
        if tune and name in grids:
            model, page["grid"] = learning.grid_search(table, estimator, grids[name])
            page["best_parameters"] = page["grid"].limit(1).select(*sorted(grids[name]))
            estimator = estimator.with_params(**model.params)
        else:
            model = learning.fit(table, estimator)
        scored = learning.predict(table, model)
        residuals = learning.residuals(scored)
        pages[name] = page | {
            "metrics": learning.metrics(scored),
            "cross_validation": learning.cross_validate(table, estimator),
            "first_20": ranking.first_rows(residuals, 20, *learning.FEATURES, "Actual"),
            "first_50": ranking.first_rows(residuals, 50, *learning.FEATURES, "Actual"),
            "error_histogram": kpi.histogram(residuals, "Error", 30, "weight"),
            "five_numbers": kpi.five_numbers(
                learning.actual_and_predicted(residuals), "Value", ["Type"], "weight"
            ),
            "importance": learning.importance(table.sparkSession, model),
        }
    return pages


def demand_patterns(sales: DataFrame) -> Page:
    levels = demand.demand_levels(sales)
    months = kpi.monthly_revenue(sales).orderBy("month")
    return {
        "kpis": demand.pattern_kpis(sales),
        "hourly": kpi.hourly_mean_units(sales).orderBy("hour"),
        "weekdays": ranking.by_weekday(kpi.weekday_units(sales)),
        "months": months.withColumn("month_name", month_label(F.col("month"))),
        "grid": shape.weekday_hour_grid(sales),
        "levels": levels,
        "level_distribution": demand.level_distribution(levels),
        "quarters": kpi.quarterly_revenue(sales).orderBy("quarter"),
    }


def workforce(sales: DataFrame, per_staff: float = 30) -> Page:
    plan = staff.staff_plan(sales, per_staff)
    return {
        "kpis": staff.staff_kpis(plan),
        "grid": shape.store_hour_grid(plan, "Required Staff"),
        "by_hour": staff.staff_by(plan, "hour").orderBy("hour"),
        "by_store": staff.staff_by(plan, "store_location").orderBy("store_location"),
        "busiest_store": staff.busiest(plan, "store_location"),
        "busiest_hour": staff.busiest(plan, "hour"),
        "weekly": staff.weekly_staff(sales, per_staff),
        "shifts": staff.shift_plan(plan),
        "store_range": staff.store_staff_range(plan),
        "busiest_slots": ranking.busiest_slots(plan),
    }


def what_if(sales: DataFrame, choice: scenario.Scenario = scenario.Scenario()) -> Page:
    base = scenario.scenario_base(sales)
    projected = scenario.project(base, [choice])
    return {
        "headline": projected,
        "comparison": scenario.comparison(projected),
        "demand": scenario.demand_curve(base, choice),
        "price": scenario.price_curve(base, choice),
        "cost": scenario.cost_curve(base, choice),
        "expansion": scenario.expansion_curve(base, choice),
        "summary": scenario.summary_table(projected),
    }


def model_comparison(transactions: DataFrame) -> Page:
    _, comparison = learning.compare_models(learning.training_table(transactions))
    return {
        "comparison": comparison,
        "best": learning.best_models(comparison),
        "errors": learning.error_measures(comparison),
        "radar": learning.radar(comparison),
    }


def monitor(
    sales: DataFrame,
    transactions: DataFrame,
    minutes: int = 60,
    feed_rows: int = 20,
    threshold: float = 2.5,
    as_of: datetime | str | None = None,
) -> Page:
    scored = anomaly.hourly_anomalies(sales, threshold)
    return {
        "rolling": rolling.rolling_kpis(transactions, minutes, as_of),
        "feed": ranking.live_feed(transactions, feed_rows),
        "anomalies": scored.orderBy("hour"),
        "anomaly_counts": anomaly.anomaly_counts(scored),
        "store_revenue": kpi.store_revenue(sales),
    }


def inventory_management(
    sales: DataFrame,
    ops: DataFrame,
    lead_time_days: float = 3,
    service_z: float = 1.65,
    horizon_days: int = 14,
    categories: list[str] | None = None,
) -> Page:
    """``ops``: measured fill rate, lead time and punctuality per store."""
    abc = inventory.abc_classes(sales)
    metrics = inventory.inventory_metrics(sales, lead_time_days, service_z)
    proposals = inventory.order_proposals(inventory.category_forecast(sales, horizon_days))
    chosen = filters.among(proposals, "product_category", categories or [])
    scored = inventory.supply_chain(sales, ops)
    return {
        "counts": kpi.distinct_counts(sales),
        "abc": abc,
        "abc_counts": inventory.class_counts(abc),
        "abc_table": inventory.abc_table(abc),
        "class_a": filters.keys_with_label(abc, "product_category", "ABC_Class", "A"),
        "metrics": metrics,
        "kpis": inventory.inventory_kpis(metrics),
        "high_risk": filters.keys_with_label(metrics, "product_category", "risk_label", "High"),
        "supply_chain": scored,
        "supply_table": inventory.supply_table(scored),
        "proposals": chosen,
        "order_summary": inventory.order_summary(chosen),
    }

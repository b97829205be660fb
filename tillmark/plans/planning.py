"""Workforce, demand, scenario, inventory and anomaly operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, demand, inventory, scenario, workforce
from ..operators.scenario import Scenario
from ..sources import adapters
from .common import EV, LI, even, line_sales, m, over, q, rounded, sales

SCENARIOS = [
    Scenario("optimistic", 50, 10, 0, 3),
    Scenario("base"),
    Scenario("pessimistic", -30, -5, 15, 0),
]


def _plan(spark, folder, per_staff=30):
    return workforce.staff_plan(sales(spark, folder), per_staff)


def _projected(spark, folder):
    return scenario.project(scenario.scenario_base(line_sales(spark, folder)), SCENARIOS)


def _base(spark, folder):
    return scenario.scenario_base(line_sales(spark, folder))


def _metrics(spark, folder):
    return inventory.inventory_metrics(line_sales(spark, folder))


def _proposals(spark, folder):
    return inventory.order_proposals(inventory.category_forecast(line_sales(spark, folder)))


def _scored(spark, folder):
    return inventory.supply_chain(line_sales(spark, folder), adapters.store_operations(spark, folder))


def _scenario_columns(df):
    return df.select(
        *[c for c in ("store_location",) if c in df.columns], "scenario_id", "scenario_revenue",
        "scenario_transactions", "scenario_avg_order", "scenario_cost", "scenario_profit", "revenue_delta",
        "profit_delta",
    )


def do4(spark, folder):
    plan = _plan(spark, folder)
    by_hour = workforce.busiest(plan, "hour").select(F.col("hour").cast("string").alias("key"), "Required Staff")
    by_store = workforce.busiest(plan, "store_location").select(
        F.col("store_location").alias("key"), "Required Staff"
    )
    return by_hour.unionByName(by_store)


QUERIES = {
    "do1_store_hour_staff": lambda s, f: workforce.store_hour_staff(sales(s, f)),
    "do2_staff_plan": lambda s, f: _plan(s, f, 45),
    "do3_staff_kpis": lambda s, f: workforce.staff_kpis(_plan(s, f)),
    "do4_staff_by_hour": lambda s, f: workforce.staff_by(_plan(s, f), "hour"),
    "do4_staff_by_store": lambda s, f: workforce.staff_by(_plan(s, f), "store_location"),
    "do4_busiest": do4,
    "do5_weekly_staff": lambda s, f: workforce.weekly_staff(line_sales(s, f)),
    "do6_shift_plan": lambda s, f: workforce.shift_plan(_plan(s, f, 100)),
    "do7_store_staff_range": lambda s, f: workforce.store_staff_range(_plan(s, f, 12)),
    "do8_demand_levels": lambda s, f: demand.demand_levels(sales(s, f)),
    "do9_level_distribution": lambda s, f: demand.level_distribution(demand.demand_levels(sales(s, f))),
    "do10_pattern_kpis": lambda s, f: demand.pattern_kpis(sales(s, f)),
    "sn1_headline": lambda s, f: _scenario_columns(_projected(s, f)),
    "sn2_comparison": lambda s, f: scenario.comparison(_projected(s, f)),
    "sn2_summary_table": lambda s, f: scenario.summary_table(_projected(s, f)),
    "sn3_demand_curve": lambda s, f: scenario.demand_curve(_base(s, f)),
    "sn4_price_curve": lambda s, f: scenario.price_curve(_base(s, f)),
    "sn5_cost_curve": lambda s, f: scenario.cost_curve(_base(s, f)),
    "sn6_expansion_curve": lambda s, f: scenario.expansion_curve(_base(s, f)),
    "sn7_store_scenarios": lambda s, f: _scenario_columns(scenario.store_scenarios(line_sales(s, f), SCENARIOS)),
    "in1_abc_classes": lambda s, f: rounded(inventory.abc_classes(line_sales(s, f)), "Revenue_Pct", "Cumulative_Pct"),
    "in1_abc_brands": lambda s, f: inventory.abc_classes(line_sales(s, f), "product_type").select(
        "product_type", "ABC_Class"
    ),
    "in2_class_counts": lambda s, f: inventory.class_counts(inventory.abc_classes(line_sales(s, f))),
    "in3_stock_levels": lambda s, f: rounded(
        inventory.stock_levels(line_sales(s, f)), "avg_daily_demand", "std_daily_demand"
    ),
    "in4_inventory_metrics": lambda s, f: _metrics(s, f).select(
        "product_category", "days_of_supply", "stockout_risk_pct", "risk_label"
    ),
    "in5_inventory_kpis": lambda s, f: rounded(
        inventory.inventory_kpis(_metrics(s, f)), "total_safety_stock", "avg_reorder_point"
    ),
    "in6_store_supply": lambda s, f: rounded(
        inventory.store_supply(line_sales(s, f)), "avg_daily_units", "demand_variability"
    ),
    "in7_supply_chain": lambda s, f: _scored(s, f).select(
        "store_location", "fill_rate", "avg_lead_time_days", "on_time_delivery", "efficiency_score"
    ),
    "in7_supply_table": lambda s, f: inventory.supply_table(_scored(s, f)).drop("Avg Lead Time (days)"),
    "in8_category_forecast": lambda s, f: inventory.category_forecast(line_sales(s, f)),
    "in9_order_proposals": lambda s, f: _proposals(s, f).select(
        "product_category", "forecast_day", "recommended_order", "urgency"
    ),
    "in10_order_summary": lambda s, f: rounded(
        inventory.order_summary(_proposals(s, f)), "Total Forecast (units)", "Recommended Order"
    ),
    "an1_hourly_anomalies": lambda s, f: rounded(anomaly.hourly_anomalies(sales(s, f), 1.5), "z_score"),
    "an2_anomaly_counts": lambda s, f: anomaly.anomaly_counts(anomaly.hourly_anomalies(sales(s, f), 1.5)),
}


def _staff(per: int = 30) -> str:
    return f"""--with
slots AS (SELECT store_location, hour, {q()} AS u FROM ev GROUP BY ALL),
plan AS (SELECT *, CAST(ceil(u / {per}) AS BIGINT) AS staff FROM slots)
"""


_LEVELS = f"""--with
s AS (SELECT weekday_num, weekday, hour, {q()} AS u FROM ev GROUP BY ALL),
e AS (SELECT min(u) AS e0, quantile_cont(u, 0.25) AS e1, quantile_cont(u, 0.5) AS e2,
  quantile_cont(u, 0.75) AS e3, max(u) AS e4 FROM s),
levels AS (SELECT weekday_num, weekday, hour, u AS transaction_qty,
  CASE WHEN e0 >= e1 OR e1 >= e2 OR e2 >= e3 OR e3 >= e4 THEN 'Medium' WHEN u <= e1 THEN 'Low'
    WHEN u <= e2 THEN 'Medium' WHEN u <= e3 THEN 'High' ELSE 'Extreme' END AS "Demand_Level" FROM s, e)
"""


def _numbers(base: str) -> str:
    """Scenario formulas over ``base(R, N, S)`` and the scenario list."""
    return f"""--with
base AS ({base}),
b AS (SELECT *, R / N AS A, R / greatest(S, 1) AS rps, R * 0.6::DOUBLE AS cb, R - R * 0.6::DOUBLE AS bp FROM base),
sc(scenario_id, d, p, c, n) AS (VALUES ('optimistic', 50.0::DOUBLE, 10.0::DOUBLE, 0.0::DOUBLE, 3),
  ('base', 20.0, 10.0, 5.0, 1), ('pessimistic', -30.0, -5.0, 15.0, 0)),
x AS (SELECT *, R * (1 + d / 100) * (1 + p / 100) + n * rps * (1 + d / 100) AS sr, N_ * (1 + d / 100) AS st,
    A * (1 + p / 100) AS sa, cb * (1 + c / 100) + n * cb / S AS sc_
  FROM (SELECT b.* EXCLUDE (N), b.N AS N_, sc.* FROM b, sc)),
y AS (SELECT *, sr - sc_ AS sp FROM x)
"""


_WHOLE = f"SELECT {m()} AS R, count(*) AS N, count(DISTINCT store_location) AS S FROM li"
_STORES = f"SELECT store_location, {m()} AS R, count(*) AS N, 1 AS S FROM li GROUP BY 1"
_SHOWN = """scenario_id, sr AS scenario_revenue, st AS scenario_transactions, sa AS scenario_avg_order,
  sc_ AS scenario_cost, sp AS scenario_profit, sr - R AS revenue_delta, sp - bp AS profit_delta"""

_INV = f"""--with
d AS (SELECT product_category, date, {q()} AS u FROM li GROUP BY ALL),
s AS (SELECT product_category, avg(u) AS mean, coalesce(stddev_samp(u), 0) AS std FROM d GROUP BY 1),
r AS (SELECT product_category, {m()} AS total_revenue FROM li GROUP BY 1),
ss AS (SELECT *, {even("1.65::DOUBLE * std * sqrt(3)", 1)} AS safety_stock FROM s JOIN r USING (product_category)),
rp AS (SELECT *, {even("mean * 3 + safety_stock", 1)} AS reorder_point,
  {even("sqrt(2 * mean * 50 / 0.2::DOUBLE)")} AS eoq FROM ss),
inv AS (SELECT *, coalesce({even("reorder_point / nullif(mean, 0)", 1)}, 0) AS days_of_supply,
  {even("coalesce(std / nullif(mean, 0), 0) * 100", 1)} AS stockout_risk_pct FROM rp),
labelled AS (SELECT *, CASE WHEN stockout_risk_pct > 40 THEN 'High' WHEN stockout_risk_pct > 20 THEN 'Medium'
  ELSE 'Low' END AS risk_label FROM inv)
"""

_SUPPLY = f"""--with
d AS (SELECT store_location, date, {q()} AS u FROM li GROUP BY ALL),
s AS (SELECT store_location, avg(u) AS mean, coalesce(stddev_samp(u), 0) AS std, sum(u) AS total FROM d GROUP BY 1),
r AS (SELECT store_location, {m()} AS revenue FROM li GROUP BY 1),
j AS (SELECT r_name, l_quantity AS lq, l_linestatus, CASE WHEN date_diff('day', o_orderdate, l_shipdate) >= 0
    THEN date_diff('day', o_orderdate, l_shipdate) END AS lead
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ops AS (SELECT r_name AS store_location, sum(CASE WHEN l_linestatus = 'F' THEN lq ELSE 0 END) / sum(lq) AS fill_rate,
  avg(lead) AS avg_lead_time_days, count(*) FILTER (lead <= 365) / count(lead) AS on_time_delivery FROM j GROUP BY 1),
scored AS (SELECT *, {even('''fill_rate * 40 + on_time_delivery * 40
  + (1 - least(greatest(std / (mean + 1), 0.0::DOUBLE), 1.0::DOUBLE)) * 20''', 1)} AS efficiency_score,
  {even("total / (mean * 7 + 1)", 1)} AS inventory_turnover
  FROM s JOIN r USING (store_location) LEFT JOIN ops USING (store_location))
"""

_FORECAST = f"""--with
d AS (SELECT product_category, date, {q()} AS u FROM li GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY product_category ORDER BY date) AS a,
  row_number() OVER (PARTITION BY product_category ORDER BY date DESC) AS b FROM d),
s AS (SELECT product_category, avg(u) AS mean, coalesce(stddev_samp(u), 0) AS std, count(*) AS n,
  CASE WHEN count(*) >= 14 THEN (avg(u) FILTER (b <= 7) - avg(u) FILTER (a <= 7)) / 7 ELSE 0.0::DOUBLE END AS trend
  FROM r GROUP BY 1),
f AS (SELECT product_category, CAST(i AS INTEGER) AS forecast_day,
  {even("greatest(0.0::DOUBLE, mean + trend * i)", 1)} AS forecast_units,
  {even("greatest(0.0::DOUBLE, mean + trend * i - 1.65::DOUBLE * std)", 1)} AS lower_bound,
  {even("mean + trend * i + 1.65::DOUBLE * std", 1)} AS upper_bound
  FROM s, range(1, 15) AS t(i) WHERE n >= 7),
o AS (SELECT *, {even("upper_bound * 1.1::DOUBLE")} AS recommended_order,
  CASE WHEN forecast_units > lower_bound * 1.5::DOUBLE THEN 'High' WHEN forecast_units > lower_bound THEN 'Medium'
    ELSE 'Low' END AS urgency FROM f)
"""

_ABC = """--with
c AS (SELECT {key}, {m} AS r, {q} AS u FROM li GROUP BY 1),
i AS (SELECT *, CAST(r AS DECIMAL(38, 9)) AS k FROM c),
w AS (SELECT {key}, r AS "Revenue", u AS "Quantity",
  CAST(k AS DOUBLE) / CAST(sum(k) OVER () AS DOUBLE) * 100 AS "Revenue_Pct",
  CAST(sum(k) OVER (ORDER BY r DESC, {key}) AS DOUBLE) / CAST(sum(k) OVER () AS DOUBLE) * 100 AS "Cumulative_Pct"
  FROM i),
abc AS (SELECT *, CASE WHEN "Cumulative_Pct" <= 70 THEN 'A' WHEN "Cumulative_Pct" <= 90 THEN 'B' ELSE 'C' END
  AS "ABC_Class" FROM w)
"""


def _abc(key: str = "product_category") -> str:
    return _ABC.format(key=key, m=m(), q=q())


_Z = f"""--with
h AS (SELECT hour, {q()} AS u FROM ev GROUP BY hour),
z AS (SELECT hour, u AS transaction_qty,
  (u - (SELECT avg(u) FROM h)) / ((SELECT stddev_samp(u) FROM h) + 1e-9) AS z_score FROM h),
flags AS (SELECT *, coalesce(abs(z_score) > 1.5, false) AS is_anomaly FROM z)
"""

_NUMBER_LINES = [
    ("Revenue", "R", "sr"), ("Transactions", "N_", "st"), ("Avg Order Value", "A", "sa"), ("Profit", "bp", "sp"),
]
_COMPARED = " UNION ALL ".join(
    f"""SELECT scenario_id, '{t}' AS "Metric", CAST({b} AS DOUBLE) AS "Baseline", CAST({s} AS DOUBLE) AS "Scenario",
    {even(f"({s} - {b}) / nullif(abs({b}), 0) * 100", 1)} AS "Change (%)" FROM y"""
    for t, b, s in _NUMBER_LINES
)
_SUMMARY = " UNION ALL ".join(
    [
        f"""SELECT scenario_id, '{t}' AS "Metric", '{sign}' || format('{{:{k}f}}', CAST({b} AS DOUBLE)) AS "Baseline",
        '{sign}' || format('{{:{k}f}}', CAST({s} AS DOUBLE)) AS "Scenario" FROM y"""
        for (t, b, s), sign, k in zip(_NUMBER_LINES, ["$", "", "$", "$"], [",.0", ",.0", ".2", ",.0"])
    ]
    + [
        """SELECT scenario_id, 'Change (%)', '—', CASE WHEN sr >= R THEN '+' ELSE '' END
        || format('{:.1f}', (sr - R) / R * 100) || '%' FROM y"""
    ]
)

ORACLE = {
    "do1_store_hour_staff": over(
        EV,
        _staff() + 'SELECT store_location, hour, u AS "Transactions", ceil(u / 30) AS "Required_Staff" FROM slots',
    ),
    "do2_staff_plan": over(
        EV, _staff(45) + 'SELECT store_location, hour, u AS "Transactions", staff AS "Required Staff" FROM plan'
    ),
    "do3_staff_kpis": over(
        EV,
        _staff() + f"""SELECT CAST(sum(staff) AS BIGINT) AS total_staff_hours, max(staff) AS peak_staff,
          {even("avg(staff)", 1)} AS avg_staff,
          (SELECT store_location FROM plan ORDER BY staff DESC, store_location, hour LIMIT 1) AS peak_store,
          (SELECT hour FROM plan ORDER BY staff DESC, store_location, hour LIMIT 1) AS peak_hour FROM plan""",
    ),
    "do4_staff_by_hour": over(
        EV, _staff() + 'SELECT hour, CAST(sum(staff) AS BIGINT) AS "Required Staff" FROM plan GROUP BY 1'
    ),
    "do4_staff_by_store": over(
        EV, _staff() + 'SELECT store_location, CAST(sum(staff) AS BIGINT) AS "Required Staff" FROM plan GROUP BY 1'
    ),
    "do4_busiest": over(
        EV,
        _staff() + """(SELECT CAST(hour AS VARCHAR) AS key, CAST(sum(staff) AS BIGINT) AS "Required Staff"
          FROM plan GROUP BY hour ORDER BY 2 DESC, hour LIMIT 1)
        UNION ALL (SELECT store_location, CAST(sum(staff) AS BIGINT) FROM plan
          GROUP BY store_location ORDER BY 2 DESC, store_location LIMIT 1)""",
    ),
    "do5_weekly_staff": over(
        LI,
        f"""--with w AS (SELECT weekday_num, weekday, {q()} AS u, CAST(ceil({q()} / 30) AS BIGINT) AS staff
          FROM li GROUP BY ALL)
        SELECT weekday_num, weekday, u AS transaction_qty, staff AS "Required Staff", avg(staff) OVER () AS average,
          staff > avg(staff) OVER () AS above_average FROM w""",
    ),
    "do6_shift_plan": over(
        EV,
        _staff(100) + """, h AS (SELECT hour, CAST(sum(staff) AS BIGINT) AS staff FROM plan GROUP BY hour),
        t AS (SELECT CAST(max(staff) AS DOUBLE) AS top FROM h)
        SELECT hour, staff AS "Required Staff", CASE WHEN staff <= 0 THEN NULL
          WHEN staff <= top * 0.33::DOUBLE THEN 'Skeleton Crew' WHEN staff <= top * 0.67::DOUBLE THEN 'Standard Shift'
          ELSE 'Peak Shift' END AS "Shift" FROM h, t""",
    ),
    "do7_store_staff_range": over(
        EV,
        _staff(12) + 'SELECT store_location AS "Store", avg(staff) AS "Avg Staff", max(staff) AS "Peak Staff"'
        " FROM plan GROUP BY 1",
    ),
    "do8_demand_levels": over(EV, _LEVELS + "SELECT * FROM levels"),
    "do9_level_distribution": over(
        EV, _LEVELS + 'SELECT "Demand_Level", count(*) AS "Count" FROM levels GROUP BY 1'
    ),
    "do10_pattern_kpis": over(
        EV,
        f"""SELECT
          (SELECT hour FROM ev GROUP BY hour ORDER BY {q()} / count(*) DESC, hour LIMIT 1) AS peak_hour,
          (SELECT weekday FROM ev GROUP BY weekday ORDER BY {q()} DESC, weekday LIMIT 1) AS busiest_day,
          (SELECT month FROM ev GROUP BY month ORDER BY {m()} DESC, month LIMIT 1) AS best_month,
          (SELECT hour FROM ev GROUP BY hour ORDER BY {q()} / count(*), hour LIMIT 1) AS quietest_hour""",
    ),
    "sn1_headline": over(LI, _numbers(_WHOLE) + f"SELECT {_SHOWN} FROM y"),
    "sn2_comparison": over(LI, _numbers(_WHOLE) + _COMPARED),
    "sn2_summary_table": over(LI, _numbers(_WHOLE) + _SUMMARY),
    "sn3_demand_curve": over(
        LI,
        _numbers(_WHOLE) + """SELECT CAST(i AS INTEGER) AS "Demand Change (%)",
          R * (1 + i / 100) * (1 + 10 / 100) + 1 * rps * (1 + i / 100) AS "Revenue" FROM b, range(-50, 101, 10) AS t(i)""",
    ),
    "sn4_price_curve": over(
        LI,
        _numbers(_WHOLE) + """SELECT CAST(i AS INTEGER) AS "Price Change (%)",
          R * (1 + 20 / 100) * (1 + i / 100) + 1 * rps AS "Revenue" FROM b, range(-30, 51, 5) AS t(i)""",
    ),
    "sn5_cost_curve": over(
        LI,
        _numbers(_WHOLE) + """SELECT CAST(i AS INTEGER) AS "Cost Change (%)",
          R * (1 + 20 / 100) * (1 + 10 / 100) + 1 * rps * (1 + 20 / 100) - (cb * (1 + i / 100) + 1 * cb / S) AS "Profit"
        FROM b, range(-20, 51, 5) AS t(i)""",
    ),
    "sn6_expansion_curve": over(
        LI,
        _numbers(_WHOLE) + """, e AS (SELECT CAST(i AS INTEGER) AS k,
          R * (1 + 20 / 100) * (1 + 10 / 100) + i * rps AS v FROM b, range(0, 6) AS t(i))
        SELECT k AS "New Stores", v AS "Revenue",
          '$' || CAST(CAST(round_even(v / 1000, 0) AS BIGINT) AS VARCHAR) || 'k' AS label FROM e""",
    ),
    "sn7_store_scenarios": over(LI, _numbers(_STORES) + f"SELECT store_location, {_SHOWN} FROM y"),
    "in1_abc_classes": over(
        LI,
        _abc() + """SELECT * REPLACE (round("Revenue_Pct", 6) AS "Revenue_Pct", round("Cumulative_Pct", 6) AS "Cumulative_Pct")
        FROM abc""",
    ),
    "in1_abc_brands": over(LI, _abc("product_type") + 'SELECT product_type, "ABC_Class" FROM abc'),
    "in2_class_counts": over(LI, _abc() + 'SELECT "ABC_Class", count(*) AS "Count" FROM abc GROUP BY 1'),
    "in3_stock_levels": over(
        LI,
        _INV + """SELECT product_category, round(mean, 6) AS avg_daily_demand, round(std, 6) AS std_daily_demand,
          total_revenue, safety_stock, reorder_point, eoq FROM rp""",
    ),
    "in4_inventory_metrics": over(
        LI, _INV + "SELECT product_category, days_of_supply, stockout_risk_pct, risk_label FROM labelled"
    ),
    "in5_inventory_kpis": over(
        LI,
        _INV + """SELECT round(sum(safety_stock), 6) AS total_safety_stock,
          round(avg(reorder_point), 6) AS avg_reorder_point,
          count(*) FILTER (risk_label = 'High') AS high_risk_categories FROM labelled""",
    ),
    "in6_store_supply": over(
        LI,
        _SUPPLY + """SELECT store_location, round(mean, 6) AS avg_daily_units, round(std, 6) AS demand_variability,
          total AS total_units, revenue, inventory_turnover FROM scored""",
    ),
    "in7_supply_chain": over(
        LI,
        _SUPPLY + "SELECT store_location, fill_rate, avg_lead_time_days, on_time_delivery, efficiency_score FROM scored",
    ),
    "in7_supply_table": over(
        LI,
        _SUPPLY + f"""SELECT store_location AS "Store", CAST({even("fill_rate * 100", 1)} AS VARCHAR) || '%' AS "Fill Rate",
          CAST({even("on_time_delivery * 100", 1)} AS VARCHAR) || '%' AS "On-Time Delivery",
          inventory_turnover AS "Inventory Turnover", efficiency_score AS "Efficiency Score" FROM scored""",
    ),
    "in8_category_forecast": over(LI, _FORECAST + "SELECT * FROM f"),
    "in9_order_proposals": over(
        LI, _FORECAST + "SELECT product_category, forecast_day, recommended_order, urgency FROM o"
    ),
    "in10_order_summary": over(
        LI,
        _FORECAST + """SELECT product_category AS "Category", round(sum(forecast_units), 6) AS "Total Forecast (units)",
          round(sum(recommended_order), 6) AS "Recommended Order",
          count(*) FILTER (urgency = 'High') AS "High-Urgency Days" FROM o GROUP BY 1""",
    ),
    "an1_hourly_anomalies": over(
        EV, _Z + "SELECT hour, transaction_qty, round(z_score, 6) AS z_score, is_anomaly FROM flags"
    ),
    "an2_anomaly_counts": over(
        EV,
        _Z + """SELECT count(*) FILTER (NOT is_anomaly) AS normal_hours, count(*) FILTER (is_anomaly) AS anomalous_hours,
          coalesce(string_agg(hour || ':00', ', ' ORDER BY hour) FILTER (is_anomaly), '') AS hours FROM flags""",
    ),
}

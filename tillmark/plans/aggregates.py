"""Aggregations, joins, ordered analytics, sorting, reshaping as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import arg_best
from ..operators import (
    anomaly, clean, demand, inventory, kpi, learning, ranking, rolling, series, shape, workforce,
)
from ..session import shared_path
from ..sources import adapters, transactions
from .common import EV, LI, RAW, TIME, even, line_sales, m, over, plain, q, rounded, sales
from . import rollup
from .rollup import hourly_rollup


def _spread(spark, folder, key):
    stats = kpi.daily_spread(line_sales(spark, folder), key)
    return rounded(stats.drop("revenue"), "mean_units", "std_units")


def _plan(spark, folder):
    return workforce.staff_plan(sales(spark, folder))


def _forecast(spark, folder):
    return series.moving_average(sales(spark, folder), "transaction_qty", ["store_location"])


def _baseline(spark, folder):
    """Held-out rows with the mean training quantity of their hour."""
    return learning.mean_model(learning.training_table(sales(spark, folder)))


def ag9_bitmaps(spark, folder):
    """Distinct ids from stored bitmaps of each day."""
    return rollup.distinct_from_bitmaps(rollup.stored_ids(line_sales(spark, folder), shared_path(spark, "ids")))


def ag9_sketches(spark, folder):
    """Whether estimates from stored sketches are within 4 % of the exact numbers."""
    facts = line_sales(spark, folder)
    guess = rollup.distinct_from_sketches(rollup.stored_ids(facts, shared_path(spark, "sketches"), exact=False))
    exact = kpi.distinct_transactions(facts).withColumnRenamed("transaction_id", "exact")
    near = F.abs(F.col("transaction_id") / F.col("exact") - 1) < 0.04
    return guess.join(exact, "store_location").select("store_location", "exact", near.alias("near"))


def ag17(spark, folder):
    """The best and the worst day."""
    days = kpi.daily_sales(line_sales(spark, folder))
    best = arg_best(days, "Revenue", "date").withColumn("which", F.lit("best"))
    worst = arg_best(days, "Revenue", "date", largest=False).withColumn("which", F.lit("worst"))
    return plain(shape.stack([best, worst]))


def jo3(spark, folder):
    proposals = inventory.category_forecast(line_sales(spark, folder), 30)
    return proposals.select("product_category", "forecast_day")


def wi4(spark, folder):
    return series.moving_average(sales(spark, folder), periods=1).select("series_key", "yhat")


def so4(spark, folder):
    return plain(
        ranking.first_rows(sales(spark, folder), 50, "transaction_time", "transaction_id").select(
            "transaction_id", "transaction_time", "revenue"
        )
    )


def se2(spark, folder):
    rows = learning.split_rows(sales(spark, folder))
    whole = learning.full_rows(rows)
    return whole.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("units"))


def se3(spark, folder):
    tagged = learning.actual_and_predicted(learning.residuals(_baseline(spark, folder)))
    return tagged.groupBy("Type").agg(
        F.sum("weight").cast("long").alias("rows"), F.round(F.sum(F.col("Value") * F.col("weight")), 3).alias("total")
    )


def se4(spark, folder):
    """Forecast totals of two horizons below each other."""
    totals = [
        series.moving_average(sales(spark, folder), "transaction_qty", periods=h)
        .agg(F.sum("yhat").alias("Forecast Total")).withColumn("Horizon", F.lit(f"{h}h"))
        for h in (12, 48)
    ]
    return rounded(shape.stack(totals), "Forecast Total")


def re3(spark, folder):
    stores = kpi.store_performance(line_sales(spark, folder)).withColumn(
        "Transactions", F.col("Transactions").cast("double")
    )
    return shape.melt(stores, ["store_location"], ["Revenue", "Transactions", "Quantity"])


def rollup_daily(spark, folder):
    return plain(kpi.daily_sales(hourly_rollup(sales(spark, folder))))


QUERIES = {
    "ag1_kpis": lambda s, f: kpi.kpis(line_sales(s, f)),
    "ag2_store_performance": lambda s, f: kpi.store_performance(line_sales(s, f)),
    "ag3_category_totals": lambda s, f: kpi.category_totals(line_sales(s, f)),
    "ag3_category_sorted": lambda s, f: ranking.sort_desc(
        kpi.category_totals(sales(s, f)), "Revenue", "product_category"
    ),
    "ag4_daily_sales": lambda s, f: plain(kpi.daily_sales(line_sales(s, f))),
    "ag4_daily_sales_from_rollup": rollup_daily,
    "ag5_hourly_demand": lambda s, f: kpi.hourly_demand(sales(s, f)),
    "ag6_hourly_mean": lambda s, f: kpi.hourly_mean_units(sales(s, f)),
    "ag6_weekday_units": lambda s, f: kpi.weekday_units(line_sales(s, f)),
    "ag6_monthly_revenue": lambda s, f: kpi.monthly_revenue(line_sales(s, f)),
    "ag7_weekday_hour": lambda s, f: kpi.weekday_hour_units(sales(s, f)),
    "ag8_quarterly_revenue": lambda s, f: kpi.quarterly_revenue(line_sales(s, f)),
    "ag9_distinct_transactions": lambda s, f: kpi.distinct_transactions(line_sales(s, f)),
    "ag9_from_bitmaps": ag9_bitmaps,
    "ag9_from_sketches": ag9_sketches,
    "ag10_distinct_counts": lambda s, f: kpi.distinct_counts(line_sales(s, f)),
    "ag11_store_revenue": lambda s, f: kpi.store_revenue(sales(s, f)),
    "ag12_daily_spread_category": lambda s, f: _spread(s, f, "product_category"),
    "ag12_daily_spread_store": lambda s, f: _spread(s, f, "store_location"),
    "ag13_value_counts": lambda s, f: kpi.value_counts(line_sales(s, f), "product_type"),
    "ag14_conditional_count": lambda s, f: kpi.count_matching(
        line_sales(s, f), F.col("is_weekend") == 1, "weekend_lines"
    ),
    "ag15_store_staff_range": lambda s, f: workforce.store_staff_range(_plan(s, f)),
    "ag16_column_summary": lambda s, f: kpi.column_summary(kpi.daily_sales(line_sales(s, f)), "Quantity"),
    "ag17_arg_best": ag17,
    "ag18_forecast_by_hour": lambda s, f: rounded(series.forecast_by_hour(_forecast(s, f)), "yhat"),
    "ag19_revenue_share": lambda s, f: kpi.share_of_total(kpi.category_totals(line_sales(s, f)), "Quantity"),
    "ag20_histogram": lambda s, f: kpi.histogram(line_sales(s, f), "revenue"),
    "ag21_five_numbers": lambda s, f: kpi.five_numbers(line_sales(s, f), "unit_price", ["product_category"]),
    "ag21_five_numbers_all": lambda s, f: kpi.five_numbers(sales(s, f), "unit_price"),
    "jo1_category_revenue": lambda s, f: inventory.stock_levels(line_sales(s, f)).select(
        "product_category", "total_revenue", "avg_daily_demand"
    ),
    "jo2_store_revenue": lambda s, f: inventory.store_supply(line_sales(s, f)).select(
        "store_location", "revenue", "total_units"
    ),
    "jo3_category_days": jo3,
    "jo4_actual_vs_predicted": lambda s, f: learning.residuals(_baseline(s, f))
    .groupBy("Actual", "Predicted", "Error").agg(F.sum("weight").cast("long").alias("rows")),
    "jo5_star_join": lambda s, f: plain(adapters.order_transactions(s, f)),
    "jo6_gap_fill": lambda s, f: plain(series.resample(sales(s, f), "transaction_qty", "hour", ["store_location"])),
    "wi1_percent_of_total": lambda s, f: rounded(
        inventory.abc_classes(line_sales(s, f)).select("product_category", "Revenue_Pct"), "Revenue_Pct"
    ),
    "wi2_running_percent": lambda s, f: rounded(
        inventory.abc_classes(line_sales(s, f), "product_type").select("product_type", "Cumulative_Pct"), "Cumulative_Pct"
    ),
    "wi3_first_last_seven": lambda s, f: inventory.demand_trend(line_sales(s, f)).select(
        "product_category", "first7", "last7", "count", "trend"
    ),
    "wi4_last_buckets_mean": wi4,
    "wi5_z_score": lambda s, f: rounded(anomaly.hourly_anomalies(sales(s, f)).drop("is_anomaly"), "z_score"),
    "wi6_quartile_levels": lambda s, f: demand.demand_levels(sales(s, f)).drop("weekday_num"),
    "wi7_shift_classes": lambda s, f: workforce.shift_plan(_plan(s, f)),
    "wi8_scaled": lambda s, f: learning.radar(_measures(s, f)),
    "wi9_rolling_kpis": lambda s, f: rolling.rolling_kpis(sales(s, f), 60),
    "wi9_rolling_kpis_fallback": lambda s, f: rolling.rolling_kpis(sales(s, f), 60, "2030-01-01 00:00:00"),
    "so1_sorted_types": lambda s, f: ranking.sort_desc(
        kpi.value_counts(line_sales(s, f), "product_type"), "Count", "product_type"
    ),
    "so2_busiest_slots": lambda s, f: ranking.busiest_slots(_plan(s, f)),
    "so3_latest_feed": lambda s, f: ranking.live_feed(sales(s, f), 20),
    "so4_first_rows": so4,
    "so5_weekday_order": lambda s, f: ranking.by_weekday(kpi.weekday_units(line_sales(s, f))),
    "so6_sample": lambda s, f: ranking.sample_rows(sales(s, f), 200, keys=["transaction_id"]).select("transaction_id", "revenue"),
    "se1_distinct_rows": lambda s, f: plain(
        clean.drop_duplicate_rows(transactions.from_text(adapters.garbled_events(s, f)))
    ),
    "se2_train_and_test": se2,
    "se3_tagged_union": se3,
    "se4_stacked_totals": se4,
    "re1_store_hour_grid": lambda s, f: shape.store_hour_grid(workforce.store_hour_staff(sales(s, f))),
    "re2_weekday_hour_grid": lambda s, f: shape.weekday_hour_grid(sales(s, f)),
    "re3_melt": re3,
}


def _measures(spark, folder):
    """A comparison table made of plain SQL measures, one row per store."""
    stores = kpi.store_performance(line_sales(spark, folder))
    return stores.select(
        F.col("store_location").alias("Model"),
        F.col("Revenue").alias("Accuracy (%)"),
        F.col("Quantity").alias("CV Score (%)"),
        F.col("Transactions").alias("R2 Score"),
        F.col("Quantity").alias("MAE"),
        F.col("Revenue").alias("RMSE"),
    )


_DAYS = """SELECT {key}, {mean} AS mean_units, {std} AS std_units, sum(u) AS total_units, count(*) AS days
FROM (SELECT {key}, date, sum(transaction_qty) AS u FROM li GROUP BY ALL) GROUP BY {key}"""


def _days(key: str) -> str:
    return over(LI, _DAYS.format(key=key, mean="round(avg(u), 6)", std="round(stddev_samp(u), 6)"))


_STAFF = f"""--with
slots AS (SELECT store_location, hour, {q()} AS u FROM ev GROUP BY ALL),
plan AS (SELECT *, CAST(ceil(u / 30) AS BIGINT) AS staff FROM slots)
"""
_ABC = """--with
c AS (SELECT {key}, {m} AS r FROM li GROUP BY 1),
w AS (SELECT *, r / sum(r) OVER () * 100 AS p,
  CAST(sum(CAST(r AS DECIMAL(38, 9))) OVER (ORDER BY r DESC, {key}) AS DOUBLE)
  / CAST(sum(CAST(r AS DECIMAL(38, 9))) OVER () AS DOUBLE) * 100 AS u FROM c)
"""
_MA = """--with
h AS (SELECT {key} AS series_key, date_trunc('hour', transaction_time) AS ds, {y} AS y FROM ev GROUP BY ALL),
ends AS (SELECT series_key, max(ds) AS last FROM h GROUP BY 1),
level AS (SELECT h.series_key, last,
  CAST(sum(CAST(y AS DECIMAL(38, 9))) AS DOUBLE) / 3 AS yhat
  FROM h JOIN ends USING (series_key) WHERE ds > last - INTERVAL 3 HOUR GROUP BY ALL)
"""
_TICKET = "CAST('0x' || substr(md5(CAST(transaction_id AS VARCHAR)), {start}, 8) AS BIGINT)"
_TEST = f"{_TICKET.format(start=1)} % 10 >= 8"
_RESIDUALS = f"""--with
means AS (SELECT hour, sum(transaction_qty) / count(*) AS p FROM ev WHERE NOT ({_TEST}) GROUP BY hour),
scored AS (SELECT transaction_qty AS y, p, {even("p", 1)} AS shown FROM ev JOIN means USING (hour) WHERE {_TEST})
"""
_GRID = ", ".join(f"coalesce(sum(v) FILTER (hour = {h}), 0.0::DOUBLE) AS h{h:02d}" for h in range(24))
_GRID_NULLS = ", ".join(f"sum(transaction_qty) FILTER (hour = {h}) AS h{h:02d}" for h in range(24))
_FEED = (
    "strftime(transaction_time, '%H:%M:%S') AS transaction_time, store_location, product_category, product_type,"
    f" transaction_qty, unit_price, {even('revenue', 2)} AS revenue"
)
_TXN = f"transaction_id, {TIME}, transaction_qty, unit_price, store_location, product_category, product_type"
_PERF = (
    f'SELECT store_location, {m()} AS "Revenue", count(transaction_id) AS "Transactions",'
    f' {q()} AS "Quantity" FROM li GROUP BY 1'
)
_DAILY = f'SELECT CAST(date AS VARCHAR) AS date, {m()} AS "Revenue", {q()} AS "Quantity" FROM {{t}} GROUP BY date'

ORACLE = {
    "ag1_kpis": over(
        LI,
        f"""SELECT {m()} AS "Revenue", count(*) AS "Transactions", {q()} AS "Quantity",
          {m()} / count(*) AS "Avg_Order_Value",
          (SELECT store_location FROM li GROUP BY 1 ORDER BY {m()} DESC, 1 LIMIT 1) AS "Best_Store",
          (SELECT product_category FROM li GROUP BY 1 ORDER BY {m()} DESC, 1 LIMIT 1) AS "Best_Category"
        FROM li""",
    ),
    "ag2_store_performance": over(LI, _PERF),
    "ag3_category_totals": over(
        LI, f'SELECT product_category, {m()} AS "Revenue", {q()} AS "Quantity" FROM li GROUP BY 1'
    ),
    "ag3_category_sorted": over(
        EV, f'SELECT product_category, {m()} AS "Revenue", {q()} AS "Quantity" FROM ev GROUP BY 1'
    ),
    "ag4_daily_sales": over(LI, _DAILY.format(t="li")),
    "ag4_daily_sales_from_rollup": over(EV, _DAILY.format(t="ev")),
    "ag5_hourly_demand": over(EV, f'SELECT hour, {q()} AS "Quantity", {m()} AS "Revenue" FROM ev GROUP BY hour'),
    "ag6_hourly_mean": over(EV, f'SELECT hour, {q()} / count(*) AS "Avg_Transactions" FROM ev GROUP BY hour'),
    "ag6_weekday_units": over(LI, f'SELECT weekday_num, weekday, {q()} AS "Transactions" FROM li GROUP BY ALL'),
    "ag6_monthly_revenue": over(LI, f'SELECT month, {m()} AS "Revenue" FROM li GROUP BY month'),
    "ag7_weekday_hour": over(EV, f"SELECT weekday_num, weekday, hour, {q()} AS transaction_qty FROM ev GROUP BY ALL"),
    "ag8_quarterly_revenue": over(
        LI,
        f"""SELECT quarter, {m()} AS revenue, 'Q' || quarter AS quarter_label,
          '$' || CAST(CAST(round_even({m()} / 1000, 0) AS BIGINT) AS VARCHAR) || 'k' AS revenue_label
        FROM li GROUP BY quarter""",
    ),
    "ag9_distinct_transactions": over(
        LI, "SELECT store_location, count(DISTINCT transaction_id) AS transaction_id FROM li GROUP BY 1"
    ),
    "ag9_from_bitmaps": over(
        LI, "SELECT store_location, count(DISTINCT transaction_id) AS transaction_id FROM li WHERE store_location IS NOT NULL GROUP BY 1"
    ),
    "ag9_from_sketches": over(
        LI, "SELECT store_location, count(DISTINCT transaction_id) AS exact, true AS near FROM li WHERE store_location IS NOT NULL GROUP BY 1"
    ),
    "ag10_distinct_counts": over(
        LI, "SELECT count(DISTINCT store_location) AS stores, count(DISTINCT product_category) AS categories FROM li"
    ),
    "ag11_store_revenue": over(EV, f"SELECT store_location, {m()} AS revenue FROM ev GROUP BY 1"),
    "ag12_daily_spread_category": _days("product_category"),
    "ag12_daily_spread_store": _days("store_location"),
    "ag13_value_counts": over(LI, 'SELECT product_type, count(*) AS "Count" FROM li GROUP BY 1'),
    "ag14_conditional_count": over(LI, "SELECT count(*) FILTER (is_weekend = 1) AS weekend_lines FROM li"),
    "ag15_store_staff_range": over(
        EV,
        _STAFF + 'SELECT store_location AS "Store", avg(staff) AS "Avg Staff", max(staff) AS "Peak Staff"'
        " FROM plan GROUP BY 1",
    ),
    "ag16_column_summary": over(
        LI,
        f"""SELECT sum(u) AS "sum", max(u) AS "max", min(u) AS "min", avg(u) AS mean
        FROM (SELECT {q()} AS u FROM li GROUP BY date)""",
    ),
    "ag17_arg_best": over(
        LI,
        f"""--with d AS ({_DAILY.format(t='li')})
        (SELECT *, 'best' AS which FROM d ORDER BY "Revenue" DESC, date LIMIT 1)
        UNION ALL (SELECT *, 'worst' AS which FROM d ORDER BY "Revenue", date LIMIT 1)""",
    ),
    "ag18_forecast_by_hour": over(
        EV,
        _MA.format(key="store_location", y=q())
        + """SELECT CAST(hour(last + to_hours(CAST(i AS INTEGER))) AS INTEGER) AS hour,
          round(CAST(sum(CAST(yhat AS DECIMAL(38, 9))) AS DOUBLE), 6) AS yhat
        FROM level, range(1, 13) AS r(i) GROUP BY 1""",
    ),
    "ag19_revenue_share": over(
        LI,
        f"""SELECT product_category, {m()} AS "Revenue", {q()} AS "Quantity",
          {q()} / (SELECT sum(transaction_qty) FROM li) AS share FROM li GROUP BY 1""",
    ),
    "ag20_histogram": over(
        LI,
        """--with b AS (SELECT min(revenue) AS low, max(revenue) AS high FROM li)
        SELECT CAST(least(30, floor((revenue - low) / (high - low) * 30) + 1) AS INTEGER) AS bin, count(*) AS "count"
        FROM li, b GROUP BY 1""",
    ),
    "ag21_five_numbers": over(
        LI,
        """SELECT product_category, min(unit_price) AS "min", quantile_cont(unit_price, 0.25) AS q1,
          quantile_cont(unit_price, 0.5) AS "median", quantile_cont(unit_price, 0.75) AS q3, max(unit_price) AS "max"
        FROM li GROUP BY 1""",
    ),
    "ag21_five_numbers_all": over(
        EV,
        """SELECT min(unit_price) AS "min", quantile_cont(unit_price, 0.25) AS q1,
          quantile_cont(unit_price, 0.5) AS "median", quantile_cont(unit_price, 0.75) AS q3, max(unit_price) AS "max"
        FROM ev""",
    ),
    "jo1_category_revenue": over(
        LI,
        f"""--with d AS (SELECT product_category, date, {q()} AS u FROM li GROUP BY ALL),
        s AS (SELECT product_category, avg(u) AS avg_daily_demand FROM d GROUP BY 1),
        r AS (SELECT product_category, {m()} AS total_revenue FROM li GROUP BY 1)
        SELECT * FROM s LEFT JOIN r USING (product_category)""",
    ),
    "jo2_store_revenue": over(
        LI,
        f"""--with s AS (SELECT store_location, {q()} AS total_units FROM li GROUP BY 1),
        r AS (SELECT store_location, {m()} AS revenue FROM li GROUP BY 1)
        SELECT * FROM s LEFT JOIN r USING (store_location)""",
    ),
    "jo3_category_days": over(
        LI,
        """SELECT product_category, CAST(i AS INTEGER) AS forecast_day
        FROM (SELECT product_category FROM li GROUP BY 1 HAVING count(DISTINCT date) >= 7), range(1, 31) AS r(i)""",
    ),
    "jo4_actual_vs_predicted": over(
        EV,
        _RESIDUALS + 'SELECT y AS "Actual", shown AS "Predicted", y - shown AS "Error", count(*) AS rows'
        " FROM scored GROUP BY ALL",
    ),
    "jo5_star_join": over(LI, f"SELECT {_TXN} FROM li"),
    "jo6_gap_fill": over(
        EV,
        f"""--with
        h AS (SELECT store_location, date_trunc('hour', transaction_time) AS ds, {q()} AS y FROM ev GROUP BY ALL),
        calendar AS (SELECT store_location, unnest(generate_series(min(ds), max(ds), INTERVAL 1 HOUR)) AS ds
          FROM h GROUP BY 1)
        SELECT store_location AS series_key, strftime(ds, '%Y-%m-%d %H:%M:%S') AS ds, coalesce(y, 0.0) AS y
        FROM calendar LEFT JOIN h USING (store_location, ds)""",
    ),
    "wi1_percent_of_total": over(
        LI,
        _ABC.format(key="product_category", m=m())
        + """SELECT product_category, round(r / CAST(sum(CAST(r AS DECIMAL(38, 9))) OVER () AS DOUBLE) * 100, 6)
          AS "Revenue_Pct" FROM w""",
    ),
    "wi2_running_percent": over(
        LI, _ABC.format(key="product_type", m=m()) + 'SELECT product_type, round(u, 6) AS "Cumulative_Pct" FROM w'
    ),
    "wi3_first_last_seven": over(
        LI,
        f"""--with d AS (SELECT product_category, date, {q()} AS u FROM li GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY product_category ORDER BY date) AS a,
          row_number() OVER (PARTITION BY product_category ORDER BY date DESC) AS b FROM d),
        s AS (SELECT product_category, avg(u) FILTER (a <= 7) AS first7, avg(u) FILTER (b <= 7) AS last7,
          count(*) AS "count" FROM r GROUP BY 1)
        SELECT *, CASE WHEN "count" >= 14 THEN (last7 - first7) / 7 ELSE 0.0 END AS trend FROM s""",
    ),
    "wi4_last_buckets_mean": over(
        EV, _MA.format(key="'All Stores'", y=m()) + "SELECT series_key, yhat FROM level"
    ),
    "wi5_z_score": over(
        EV,
        f"""--with h AS (SELECT hour, {q()} AS u FROM ev GROUP BY hour)
        SELECT hour, u AS transaction_qty,
          round((u - (SELECT avg(u) FROM h)) / ((SELECT stddev_samp(u) FROM h) + 1e-9), 6) AS z_score FROM h""",
    ),
    "wi6_quartile_levels": over(
        EV,
        f"""--with s AS (SELECT weekday, hour, {q()} AS u FROM ev GROUP BY ALL),
        e AS (SELECT min(u) AS e0, quantile_cont(u, 0.25) AS e1, quantile_cont(u, 0.5) AS e2,
          quantile_cont(u, 0.75) AS e3, max(u) AS e4 FROM s)
        SELECT weekday, hour, u AS transaction_qty,
          CASE WHEN e0 >= e1 OR e1 >= e2 OR e2 >= e3 OR e3 >= e4 THEN 'Medium' WHEN u <= e1 THEN 'Low'
            WHEN u <= e2 THEN 'Medium' WHEN u <= e3 THEN 'High' ELSE 'Extreme' END AS "Demand_Level" FROM s, e""",
    ),
    "wi7_shift_classes": over(
        EV,
        _STAFF + """, h AS (SELECT hour, CAST(sum(staff) AS BIGINT) AS staff FROM plan GROUP BY hour),
        t AS (SELECT CAST(max(staff) AS DOUBLE) AS top FROM h)
        SELECT hour, staff AS "Required Staff", CASE WHEN staff <= 0 THEN NULL
          WHEN staff <= top * 0.33::DOUBLE THEN 'Skeleton Crew' WHEN staff <= top * 0.67::DOUBLE THEN 'Standard Shift'
          ELSE 'Peak Shift' END AS "Shift" FROM h, t""",
    ),
    "wi8_scaled": over(
        LI,
        f"""--with p AS ({_PERF})
        SELECT store_location AS "Model", "Revenue" / max("Revenue") OVER () AS "Accuracy (%)",
          "Quantity" / max("Quantity") OVER () AS "CV Score (%)",
          "Transactions" / max("Transactions") OVER () AS "R2 Score",
          1 - "Quantity" / max("Quantity") OVER () AS "MAE", 1 - "Revenue" / max("Revenue") OVER () AS "RMSE" FROM p""",
    ),
    "wi9_rolling_kpis": over(
        EV,
        f"""SELECT {m()} AS revenue, count(*) AS transactions, {m()} / count(*) AS avg_order, 60 AS "window" FROM ev
        WHERE transaction_time >= (SELECT max(transaction_time) FROM ev) - INTERVAL 60 MINUTE""",
    ),
    "wi9_rolling_kpis_fallback": over(
        EV,
        f"""SELECT {m()} AS revenue, count(*) AS transactions, {m()} / count(*) AS avg_order, 60 AS "window"
        FROM (SELECT * FROM ev ORDER BY transaction_time DESC, transaction_id DESC LIMIT 200)""",
    ),
    "so1_sorted_types": over(LI, 'SELECT product_type, count(*) AS "Count" FROM li GROUP BY 1'),
    "so2_busiest_slots": over(
        EV,
        _STAFF + """SELECT store_location AS "Store", hour || ':00' AS "Hour", u AS "Transactions",
          staff AS "Staff Required" FROM plan ORDER BY staff DESC, store_location, hour LIMIT 20""",
    ),
    "so3_latest_feed": over(
        EV,
        f"SELECT {_FEED} FROM (SELECT * FROM ev ORDER BY transaction_time DESC, transaction_id DESC LIMIT 20)",
    ),
    "so4_first_rows": over(
        EV, f"SELECT transaction_id, {TIME}, revenue FROM"
        " (SELECT * FROM ev ORDER BY transaction_time, transaction_id LIMIT 50)"
    ),
    "so5_weekday_order": over(LI, f'SELECT weekday_num, weekday, {q()} AS "Transactions" FROM li GROUP BY ALL'),
    "so6_sample": over(
        EV, "SELECT transaction_id, revenue FROM ev ORDER BY md5(CAST(transaction_id AS VARCHAR) || '-42'), transaction_id LIMIT 200"
    ),
    "se1_distinct_rows": over(RAW, f"SELECT {_TXN} FROM (SELECT DISTINCT * FROM raw)"),
    "se2_train_and_test": over(
        EV,
        f"""SELECT CASE WHEN {_TEST} THEN 'test' ELSE 'train' END AS split, count(*) AS rows,
          sum(transaction_qty) AS units FROM ev GROUP BY 1""",
    ),
    "se3_tagged_union": over(
        EV,
        _RESIDUALS + """SELECT 'Actual' AS "Type", count(*) AS rows, round(sum(y), 3) AS total FROM scored
        UNION ALL SELECT 'Predicted', count(*), round(sum(shown), 3) FROM scored""",
    ),
    "se4_stacked_totals": over(
        EV,
        _MA.format(key="'All Stores'", y=q())
        + """SELECT round(yhat * 12, 6) AS "Forecast Total", '12h' AS "Horizon" FROM level
        UNION ALL SELECT round(yhat * 48, 6), '48h' FROM level""",
    ),
    "re1_store_hour_grid": over(
        EV,
        f"""--with p AS (SELECT store_location, hour, ceil({q()} / 30) AS v FROM ev GROUP BY ALL)
        SELECT store_location, {_GRID} FROM p GROUP BY 1""",
    ),
    "re2_weekday_hour_grid": over(EV, f"SELECT weekday_num, weekday, {_GRID_NULLS} FROM ev GROUP BY ALL"),
    "re3_melt": over(
        LI,
        f"""--with p AS ({_PERF})
        SELECT store_location, 'Revenue' AS "Metric", "Revenue" AS "Value" FROM p
        UNION ALL SELECT store_location, 'Transactions', CAST("Transactions" AS DOUBLE) FROM p
        UNION ALL SELECT store_location, 'Quantity', "Quantity" FROM p""",
    ),
}

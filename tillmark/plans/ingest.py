"""Sources, cleaning, projections and filters as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.numeric import half_even, ratio
from ..operators import anomaly, clean, enrich, filters, inventory, kpi, series
from ..session import shared_path
from ..sources import adapters, sinks, transactions
from .common import CLEAN, EV, LI, RAW, TIME, even, line_sales, m, over, plain, q, sales


def _raw(spark, folder):
    return transactions.from_text(adapters.garbled_events(spark, folder))


def _csv(spark, folder):
    path = shared_path(spark, "csv")
    adapters.garbled_events(spark, folder).write.option("header", True).csv(path)
    return path


def sc1(spark, folder):
    return plain(transactions.read_csv(spark, _csv(spark, folder)))


def sc2(spark, folder):
    mapping = adapters.event_mapping()
    return plain(transactions.read_parquet(spark, f"{folder}/events.parquet", mapping))


def sc3(spark, folder):
    return plain(transactions.load(spark, _csv(spark, folder), store=shared_path(spark, "distinct")))


def sc4(spark, folder):
    return transactions.dataset_summary(sales(spark, folder))


def sk1(spark, folder):
    daily = kpi.daily_sales(line_sales(spark, folder))
    return plain(sinks.write_table(daily, shared_path(spark, "table")))


def cl4(spark, folder):
    rows = clean.drop_missing_time(clean.drop_duplicate_rows(_raw(spark, folder)))
    return clean.impute_price(rows, clean.price_median(rows)).select("transaction_id", "unit_price")


def pr1(spark, folder):
    return plain(
        sales(spark, folder).select(
            "transaction_id", "revenue", "date", "hour", "month", "quarter", "weekday", "weekday_num", "is_weekend"
        )
    )


def pr2(spark, folder):
    lines = line_sales(spark, folder)
    stores = lines.groupBy("store_location").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("transaction_qty").alias("units"),
        F.count_if(F.col("transaction_qty") > 25).alias("large"),
    )
    return stores.select(
        "store_location",
        ratio(F.col("units"), F.col("lines")).alias("mean_units"),
        (ratio(F.col("large"), F.col("lines")) * 100).alias("large_pct"),
        ratio(F.col("units"), F.col("lines") - F.col("lines")).alias("undefined"),
    )


def pr4(spark, folder):
    days = kpi.daily_sales(line_sales(spark, folder))
    units = F.col("Quantity")
    return plain(
        days.select(
            "date",
            F.ceil(units / 30).alias("staff"),
            F.sqrt(units).alias("root"),
            F.abs(units - 500).alias("distance"),
            half_even(units / 7, 1).alias("weekly"),
            F.greatest(F.lit(0.0), units - 500).alias("excess"),
            F.least(F.greatest(units / 1000, F.lit(0.0)), F.lit(1.0)).alias("clipped"),
        )
    )


def pr5(spark, folder):
    return inventory.inventory_metrics(line_sales(spark, folder)).select(
        "product_category", "stockout_risk_pct", "risk_label"
    )


def pr6(spark, folder):
    raw = _raw(spark, folder)
    return raw.select(
        "transaction_id",
        F.coalesce("transaction_qty", F.lit("0")).alias("qty_filled"),
        F.nullif(F.col("store_location"), F.lit("Store 0")).alias("store_or_null"),
    )


def pr7(spark, folder):
    months = kpi.monthly_revenue(line_sales(spark, folder))
    return months.withColumn("month_name", text.month_label(F.col("month")))


def pr8(spark, folder):
    return kpi.quarterly_revenue(line_sales(spark, folder)).select(
        "quarter_label", "revenue_label", text.hour_label(F.col("quarter")).alias("slot")
    )


def pr10(spark, folder):
    when = F.col("transaction_time")
    return sales(spark, folder).select(
        "transaction_id", text.clock_text(when).alias("clock"), text.minute_text(when).alias("minute"),
        text.second_text(when).alias("second"),
    )


def pr11(spark, folder):
    return kpi.store_performance(line_sales(spark, folder)).select(
        F.col("store_location").alias("Store"), F.col("Quantity").alias("Units Sold")
    )


def pr12(spark, folder):
    frame = kpi.store_revenue(sales(spark, folder))
    return enrich.present(frame, ["transaction_time", "store_location", "product_type", "revenue"])


def fi2(spark, folder):
    return plain(filters.positive(series.resample(sales(spark, folder)), "y"))


def fi3(spark, folder):
    recent = filters.recent(sales(spark, folder), 240)
    return plain(recent.select("transaction_id", "transaction_time", "revenue"))


def fi4(spark, folder):
    scored = anomaly.hourly_anomalies(sales(spark, folder), 1.5)
    return filters.flagged(scored, value=False).select("hour", "transaction_qty")


def fi5(spark, folder):
    chosen = filters.among(line_sales(spark, folder), "product_category", ["ECONOMY", "PROMO", "SMALL"])
    return kpi.category_totals(chosen)


def fi6(spark, folder):
    metrics = inventory.inventory_metrics(line_sales(spark, folder))
    return filters.keys_with_label(metrics, "product_category", "risk_label", "High")


def fi7(spark, folder):
    return filters.with_history(inventory.demand_trend(line_sales(spark, folder)), "count", 14).select(
        "product_category", "count"
    )


_TXN = f"transaction_id, {TIME}, transaction_qty, unit_price, store_location, product_category, product_type"
_TIDY = f"{_TXN}, revenue, CAST(date AS VARCHAR) AS date, hour, month, quarter, weekday, weekday_num, is_weekend"
_SPREAD = f"""--with
daily AS (SELECT product_category, date, {q()} AS u FROM li GROUP BY ALL),
risk AS (SELECT product_category, count(*) AS n,
  {even("coalesce(coalesce(stddev_samp(u), 0) / nullif(avg(u), 0), 0) * 100", 1)} AS pct
  FROM daily GROUP BY product_category),
labelled AS (SELECT *, CASE WHEN pct > 40 THEN 'High' WHEN pct > 20 THEN 'Medium' ELSE 'Low' END AS label FROM risk)
"""

QUERIES = {
    "sc1_csv_scan": sc1,
    "sc2_parquet_scan": sc2,
    "sc3_load_clean_enrich": sc3,
    "sc4_dataset_summary": sc4,
    "sk1_table_writer": sk1,
    "cl1_dedup": lambda s, f: plain(clean.drop_duplicate_rows(_raw(s, f))),
    "cl2_drop_missing_time": lambda s, f: plain(clean.drop_missing_time(_raw(s, f))),
    "cl3_coerce_quantity": lambda s, f: clean.coerce_quantity(_raw(s, f)).select("transaction_id", "transaction_qty"),
    "cl4_median_price": cl4,
    "cl5_clean": lambda s, f: plain(clean.clean(_raw(s, f))),
    "pr1_enrich": pr1,
    "pr2_ratios": pr2,
    "pr3_calendar_features": lambda s, f: enrich.calendar_features(sales(s, f)).select(
        "transaction_id", "day", "month", "weekday_num"
    ),
    "pr4_math": pr4,
    "pr5_labels": pr5,
    "pr6_fill_and_nullif": pr6,
    "pr7_month_names": pr7,
    "pr8_text_labels": pr8,
    "pr9_store_table": lambda s, f: kpi.store_table(line_sales(s, f)),
    "pr9_abc_table": lambda s, f: inventory.abc_table(inventory.abc_classes(line_sales(s, f))),
    "pr10_time_texts": pr10,
    "pr11_rename": pr11,
    "pr12_present_columns": pr12,
    "fi1_store_filter": lambda s, f: kpi.daily_sales(filters.for_store(line_sales(s, f), "ASIA")).transform(plain),
    "fi2_positive": fi2,
    "fi3_time_cutoff": fi3,
    "fi4_normal_hours": fi4,
    "fi5_membership": fi5,
    "fi6_high_risk_keys": fi6,
    "fi7_min_history": fi7,
    "fi8_choices": lambda s, f: filters.choices(line_sales(s, f), "store_location"),
}

_HOURLY = f"""--with
h AS (SELECT date_trunc('hour', transaction_time) AS ds, {m()} AS y FROM ev GROUP BY 1)
"""

ORACLE = {
    "sc1_csv_scan": over(RAW, f"SELECT {_TXN} FROM raw"),
    "sc2_parquet_scan": over(EV, f"SELECT {_TXN} FROM ev"),
    "sc3_load_clean_enrich": over(CLEAN, f"SELECT {_TIDY} FROM tidy"),
    "sc4_dataset_summary": over(EV, "SELECT count(*) AS records, 15 AS columns FROM ev"),
    "sk1_table_writer": over(
        LI, f'SELECT CAST(date AS VARCHAR) AS date, {m()} AS "Revenue", {q()} AS "Quantity" FROM li GROUP BY date'
    ),
    "cl1_dedup": over(RAW, f"SELECT {_TXN} FROM (SELECT DISTINCT * FROM raw)"),
    "cl2_drop_missing_time": over(RAW, f"SELECT {_TXN} FROM raw WHERE transaction_time IS NOT NULL"),
    "cl3_coerce_quantity": over(
        RAW, "SELECT transaction_id, coalesce(TRY_CAST(transaction_qty AS DOUBLE), 0.0) AS transaction_qty FROM raw"
    ),
    "cl4_median_price": over(CLEAN, "SELECT transaction_id, unit_price FROM tidy"),
    "cl5_clean": over(CLEAN, f"SELECT {_TXN} FROM tidy"),
    "pr1_enrich": over(
        EV,
        "SELECT transaction_id, revenue, CAST(date AS VARCHAR) AS date, hour, month, quarter, weekday, weekday_num,"
        " is_weekend FROM ev",
    ),
    "pr2_ratios": over(
        LI,
        "SELECT store_location, sum(transaction_qty) / count(*) AS mean_units,"
        " count(*) FILTER (transaction_qty > 25) / count(*) * 100 AS large_pct, CAST(NULL AS DOUBLE) AS undefined"
        " FROM li GROUP BY store_location",
    ),
    "pr3_calendar_features": over(
        EV, "SELECT transaction_id, CAST(day(date) AS INTEGER) AS day, month, weekday_num FROM ev"
    ),
    "pr4_math": over(
        LI,
        f"""--with d AS (SELECT date, {q()} AS u FROM li GROUP BY date)
        SELECT CAST(date AS VARCHAR) AS date, CAST(ceil(u / 30) AS BIGINT) AS staff, sqrt(u) AS root,
          abs(u - 500) AS distance, {even("u / 7", 1)} AS weekly, greatest(0.0::DOUBLE, u - 500) AS excess,
          least(greatest(u / 1000, 0.0::DOUBLE), 1.0::DOUBLE) AS clipped FROM d""",
    ),
    "pr5_labels": over(
        LI, _SPREAD + "SELECT product_category, pct AS stockout_risk_pct, label AS risk_label FROM labelled"
    ),
    "pr6_fill_and_nullif": over(
        RAW,
        "SELECT transaction_id, coalesce(transaction_qty, '0') AS qty_filled,"
        " nullif(store_location, 'Store 0') AS store_or_null FROM raw",
    ),
    "pr7_month_names": over(
        LI, f"""SELECT month, {m()} AS "Revenue", strftime(make_date(2000, month, 1), '%b') AS month_name
        FROM li GROUP BY month"""
    ),
    "pr8_text_labels": over(
        LI,
        f"""SELECT 'Q' || quarter AS quarter_label,
          '$' || CAST(CAST(round_even({m()} / 1000, 0) AS BIGINT) AS VARCHAR) || 'k' AS revenue_label,
          quarter || ':00' AS slot FROM li GROUP BY quarter""",
    ),
    "pr9_store_table": over(
        LI,
        f"""SELECT store_location AS "Store", '$' || format('{{:,.0f}}', {m()}) AS "Revenue",
          format('{{:,}}', count(transaction_id)) AS "Transactions", format('{{:,.0f}}', {q()}) AS "Units Sold"
        FROM li GROUP BY store_location""",
    ),
    "pr9_abc_table": over(
        LI,
        f"""--with c AS (SELECT product_category, {m()} AS r FROM li GROUP BY 1),
        w AS (SELECT *, r / sum(r) OVER () * 100 AS p,
          sum(r) OVER (ORDER BY r DESC, product_category) / sum(r) OVER () * 100 AS u FROM c)
        SELECT product_category AS "Category", '$' || format('{{:,.0f}}', r) AS "Revenue ($)",
          format('{{:,.1f}}', p) || '%' AS "Revenue Share (%)", format('{{:,.1f}}', u) || '%' AS "Cumulative (%)",
          CASE WHEN u <= 70 THEN 'A' WHEN u <= 90 THEN 'B' ELSE 'C' END AS "Class" FROM w""",
    ),
    "pr10_time_texts": over(
        EV,
        "SELECT transaction_id, strftime(transaction_time, '%I:%M %p') AS clock,"
        " strftime(transaction_time, '%Y-%m-%d %H:%M') AS minute,"
        " strftime(transaction_time, '%H:%M:%S') AS second FROM ev",
    ),
    "pr11_rename": over(LI, f'SELECT store_location AS "Store", {q()} AS "Units Sold" FROM li GROUP BY 1'),
    "pr12_present_columns": over(EV, f"SELECT store_location, {m()} AS revenue FROM ev GROUP BY 1"),
    "fi1_store_filter": over(
        LI,
        f"""SELECT CAST(date AS VARCHAR) AS date, {m()} AS "Revenue", {q()} AS "Quantity"
        FROM li WHERE store_location = 'ASIA' GROUP BY date""",
    ),
    "fi2_positive": over(
        EV,
        _HOURLY + "SELECT 'All Stores' AS series_key, strftime(ds, '%Y-%m-%d %H:%M:%S') AS ds, y FROM h WHERE y > 0",
    ),
    "fi3_time_cutoff": over(
        EV,
        f"""SELECT transaction_id, {TIME}, revenue FROM ev
        WHERE transaction_time >= (SELECT max(transaction_time) FROM ev) - INTERVAL 240 MINUTE""",
    ),
    "fi4_normal_hours": over(
        EV,
        f"""--with h AS (SELECT hour, {q()} AS u FROM ev GROUP BY hour)
        SELECT hour, u AS transaction_qty FROM h
        WHERE NOT coalesce(abs((u - (SELECT avg(u) FROM h)) / ((SELECT stddev_samp(u) FROM h) + 1e-9)) > 1.5, false)""",
    ),
    "fi5_membership": over(
        LI,
        f"""SELECT product_category, {m()} AS "Revenue", {q()} AS "Quantity" FROM li
        WHERE product_category IN ('ECONOMY', 'PROMO', 'SMALL') GROUP BY 1""",
    ),
    "fi6_high_risk_keys": over(LI, _SPREAD + "SELECT product_category FROM labelled WHERE label = 'High'"),
    "fi7_min_history": over(LI, _SPREAD + 'SELECT product_category, n AS "count" FROM risk WHERE n >= 14'),
    "fi8_choices": over(LI, "SELECT DISTINCT store_location FROM li"),
}

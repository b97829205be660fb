"""Time series and forecasts as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, series
from .common import EV, LI, line_sales, m, over, plain, q, rounded, sales


def _hourly(spark, folder):
    return series.moving_average(sales(spark, folder), "revenue", ["store_location"], 24)


def ts1_daily(spark, folder):
    return plain(series.resample(line_sales(spark, folder), "revenue", "day", ["store_location"]))


def ts2(spark, folder):
    keys = ["store_location", "product_category"]
    return rounded(plain(series.moving_average(sales(spark, folder), "transaction_qty", keys, 12)), "yhat")


def ts3(spark, folder):
    return rounded(series.moving_average_kpis(sales(spark, folder)), "forecast_total", digits=3)


def ts4(spark, folder):
    return plain(series.seasonal_forecast(line_sales(spark, folder), "revenue", ["store_location"]))


def ts5(spark, folder):
    forecast = series.seasonal_forecast(line_sales(spark, folder), "revenue", ["store_location"])
    return series.forecast_totals(series.future_only(forecast))


def ts4_means(spark, folder):
    """Whether the fitted values of the history add up to the sales, as those of a mean do."""
    sales = line_sales(spark, folder)
    fit = series.seasonal_forecast(sales, "revenue", ["store_location"]).where("not is_future")
    actual = series.bucket_sums(sales, "revenue", "day", ["store_location"])
    totals = fit.groupBy("series_key").agg(F.sum("yhat").alias("fitted"))
    totals = totals.join(actual.groupBy("series_key").agg(F.sum("y").alias("actual"), F.count("*").alias("days")), "series_key")
    close = F.abs(F.col("fitted") / F.col("actual") - 1) < 0.02
    return totals.select("series_key", "days", F.round("actual", 3).alias("actual"), close.alias("close"))


def ts6(spark, folder):
    return plain(series.arima_forecast(line_sales(spark, folder), "revenue", ["store_location"]))


#: Coefficients that the recursion is checked with.
AR, MA = (0.5, -0.3), (0.4, 0.2)


def ts6_replay(spark, folder):
    found = series.arima_replay(sales(spark, folder), AR, MA, "transaction_qty", ["store_location"], 10)
    return rounded(found, "yhat", "deviation", "likelihood", digits=4)


def dates(forecast):
    """Which series and days a fitted forecast covers."""
    return plain(forecast.select("series_key", "ds"))


def ts8_table(spark, folder):
    return series.forecast_table(series.moving_average(sales(spark, folder), "transaction_qty"), "transaction_qty")


QUERIES = {
    "ts1_resample_hourly": lambda s, f: plain(series.resample(sales(s, f), "revenue", "hour", ["store_location"])),
    "ts1_resample_daily": ts1_daily,
    "ts2_moving_average": ts2,
    "ts2_one_store": lambda s, f: rounded(
        plain(series.moving_average(filters.for_store(sales(s, f), "Store 3"), periods=6)), "yhat"
    ),
    "ts3_moving_average_kpis": ts3,
    "ts4_seasonal_forecast": ts4,
    "ts4_forecast_days": lambda s, f: dates(series.seasonal_forecast(line_sales(s, f), by=["store_location"])),
    "ts4_fitted_means": ts4_means,
    "ts4_hourly_days": lambda s, f: dates(series.seasonal_forecast(sales(s, f), by=["store_location"], periods=48, freq="hour")),
    "ts5_future_totals": ts5,
    "ts5_future_days": lambda s, f: dates(
        series.future_only(series.seasonal_forecast(line_sales(s, f), by=["store_location"], periods=90))
    ),
    "ts6_arima_forecast": ts6,
    "ts6_forecast_days": lambda s, f: dates(series.arima_forecast(line_sales(s, f), by=["store_location"], periods=60)),
    "ts6_fixed_coefficients": ts6_replay,
    "ts7_compare_forecasts": lambda s, f: series.compare_forecasts(sales(s, f), "revenue", ["store_location"]),
    "ts8_forecast_by_hour": lambda s, f: rounded(series.forecast_by_hour(_hourly(s, f)), "yhat"),
    "ts8_forecast_table": ts8_table,
}


def _filled(base: str, freq: str) -> str:
    return f"""--with
h AS (SELECT store_location, date_trunc('{freq}', transaction_time) AS ds, {m()} AS y FROM {base} GROUP BY ALL),
calendar AS (SELECT store_location, unnest(generate_series(CAST(min(ds) AS TIMESTAMP), CAST(max(ds) AS TIMESTAMP),
  INTERVAL 1 {freq})) AS ds FROM h GROUP BY 1)
SELECT store_location AS series_key, strftime(ds, '%Y-%m-%d %H:%M:%S') AS ds, coalesce(y, 0.0) AS y
FROM calendar LEFT JOIN h USING (store_location, ds)"""


def _level(key: str, y: str, where: str = "true") -> str:
    return f"""--with
h AS (SELECT {key} AS series_key, date_trunc('hour', transaction_time) AS ds, {y} AS y FROM ev WHERE {where} GROUP BY ALL),
ends AS (SELECT series_key, max(ds) AS last, min(ds) AS first FROM h GROUP BY 1),
level AS (SELECT h.series_key, last,
  CAST(sum(CAST(y AS DECIMAL(38, 9))) AS DOUBLE) / 3 AS yhat
  FROM h JOIN ends USING (series_key)
  WHERE ds > last - INTERVAL 3 HOUR AND date_diff('hour', first, last) >= 2 GROUP BY ALL)
"""


def _days(ahead: int, minimum: int, history: bool) -> str:
    """Days of a fitted forecast: those with sales, if wanted, and the ones after the last."""
    future = f"""SELECT series_key, strftime(last + to_days(CAST(i AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ds
    FROM ends, range(1, {ahead + 1}) AS r(i)"""
    past = "SELECT series_key, strftime(ds, '%Y-%m-%d %H:%M:%S') AS ds FROM d JOIN ends USING (series_key) UNION ALL "
    return f"""--with
d AS (SELECT store_location AS series_key, CAST(date AS TIMESTAMP) AS ds FROM li GROUP BY ALL HAVING {m()} > 0),
ends AS (SELECT series_key, max(ds) AS last FROM d GROUP BY 1 HAVING count(*) >= {minimum})
{past if history else ''}{future}"""


_AHEAD = """SELECT series_key, strftime(last + to_hours(CAST(i AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ds,
  round(yhat, 6) AS yhat FROM level, range(1, {n}) AS r(i)"""

def _arima(ahead: int) -> str:
    """Kalman filter of ARMA(2,2) on daily changes, step by step; the starting covariance by repeated transitions.

    States (x1, x2, x3) move to (a1 x1 + x2, a2 x1 + x3, 0), shocks enter as (1, m1, m2)."""
    (a1, a2), (m1, m2) = AR, MA

    def moved(x1: str, x2: str, x3: str) -> tuple[str, str]:
        return f"({a1} * ({x1}) + ({x2}))", f"({a2} * ({x1}) + ({x3}))"

    def spread(c: dict[str, str]) -> list[str]:
        """Covariance after a transition and a shock, from entries such as c["12"]."""
        p11 = f"{a1} * ({a1} * {c['11']} + {c['12']}) + ({a1} * {c['12']} + {c['22']}) + 1"
        p12 = f"{a1} * ({a2} * {c['11']} + {c['13']}) + ({a2} * {c['12']} + {c['23']}) + {m1}"
        p22 = f"{a2} * ({a2} * {c['11']} + {c['13']}) + ({a2} * {c['13']} + {c['33']}) + {m1 * m1}"
        return [p11, p12, str(m2), p22, str(m1 * m2), str(m2 * m2)]

    entries = ["11", "12", "13", "22", "23", "33"]
    plain = {e: f"p{e}" for e in entries}
    left = {e: f"(p{e} - p1{e[0]} * p1{e[1]} / p11)" for e in entries}
    s1, s2 = moved("x1 + v", "x2 + p12 / p11 * v", "x3 + p13 / p11 * v")
    start = ", ".join(f"{v} AS p{e}" for v, e in zip(spread(plain), entries))
    step = ", ".join(f"{v} AS p{e}" for v, e in zip(spread(left), entries))
    f1, f2 = moved("x1", "x2", "x3")
    return f"""--with
h AS (SELECT store_location AS series_key, date, CAST({q()} AS DOUBLE) AS y FROM ev GROUP BY ALL HAVING {q()} > 0),
d AS (SELECT series_key, y, row_number() OVER o AS i, y - lag(y) OVER o AS w, count(*) OVER (PARTITION BY series_key) AS n
  FROM h WINDOW o AS (PARTITION BY series_key ORDER BY date)),
cov AS (SELECT 0 AS turn, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.0::DOUBLE AS p13, 0.0::DOUBLE AS p22, 0.0::DOUBLE AS p23, 0.0::DOUBLE AS p33
  UNION ALL SELECT turn + 1, {start} FROM cov WHERE turn < 200),
k AS (
  SELECT series_key, 1 AS i, n, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS x3, p11, p12, p13, p22, p23, p33,
    0.0::DOUBLE AS squares, 0.0::DOUBLE AS logs
  FROM (SELECT DISTINCT series_key, n FROM d WHERE n >= 14), cov WHERE turn = 200
  UNION ALL
  SELECT series_key, i, n, {s1} AS x1, {s2} AS x2, 0.0 AS x3, {step}, squares + v * v / p11, logs + ln(p11)
  FROM (SELECT k.* EXCLUDE (i), d.i, d.w - k.x1 AS v FROM k JOIN d ON d.series_key = k.series_key AND d.i = k.i + 1)),
f AS (
  SELECT k.series_key, 0 AS step, x1, x2, x3, d.y AS yhat, squares / (k.n - 1) AS variance,
    -0.5 * ((k.n - 1) * (ln(2 * pi() * squares / (k.n - 1)) + 1) + logs) AS likelihood,
    1.0::DOUBLE AS w1, {m1}::DOUBLE AS w2, {m2}::DOUBLE AS w3, 0.0::DOUBLE AS level, 0.0::DOUBLE AS total
  FROM k JOIN d ON d.series_key = k.series_key AND d.i = k.i WHERE k.i = k.n
  UNION ALL
  SELECT series_key, step + 1, {f1}, {f2}, 0.0, yhat + x1, variance, likelihood,
    {a1} * w1 + w2, {a2} * w1 + w3, 0.0, level + w1, total + (level + w1) * (level + w1)
  FROM f WHERE step < {ahead})
SELECT series_key, CAST(step AS BIGINT) AS step, round(yhat, 4) AS yhat, round(sqrt(variance * total), 4) AS deviation,
  round(likelihood, 4) AS likelihood FROM f WHERE step > 0"""


ORACLE = {
    "ts6_fixed_coefficients": over(EV, _arima(10)).replace("WITH", "WITH RECURSIVE", 1),
    "ts1_resample_hourly": over(EV, _filled("ev", "hour")),
    "ts1_resample_daily": over(LI, _filled("li", "day")),
    "ts2_moving_average": over(
        EV, _level("store_location || ' / ' || product_category", q()) + _AHEAD.format(n=13)
    ),
    "ts2_one_store": over(EV, _level("'All Stores'", m(), "store_location = 'Store 3'") + _AHEAD.format(n=7)),
    "ts3_moving_average_kpis": over(
        EV,
        _level("'All Stores'", m())
        + f""", t AS (SELECT 12 * yhat AS total FROM level),
        a AS (SELECT {m()} / count(*) AS aov FROM ev)
        SELECT round(total, 3) AS forecast_total,
          (SELECT strftime(ds, '%I:%M %p') FROM h ORDER BY y DESC, ds LIMIT 1) AS peak_hour,
          CAST(trunc(total / greatest(aov, 1)) AS BIGINT) AS forecast_orders FROM t, a""",
    ),
    "ts4_forecast_days": over(LI, _days(30, 7, True)),
    # Least squares with a level of its own leaves no residual on average, so the totals agree.
    "ts4_fitted_means": over(
        LI,
        f"""--with
d AS (SELECT store_location AS series_key, date, {m()} AS y FROM li GROUP BY ALL HAVING {m()} > 0)
SELECT series_key, count(*) AS days, round(CAST(sum(CAST(y AS DECIMAL(38, 9))) AS DOUBLE), 3) AS actual, true AS close
FROM d GROUP BY 1 HAVING count(*) >= 7""",
    ),
    "ts4_hourly_days": over(
        EV,
        f"""--with
d AS (SELECT store_location AS series_key, date_trunc('hour', transaction_time) AS ds FROM ev GROUP BY ALL HAVING {m()} > 0),
ends AS (SELECT series_key, max(ds) AS last FROM d GROUP BY 1 HAVING count(*) >= 7)
SELECT series_key, strftime(ds, '%Y-%m-%d %H:%M:%S') AS ds FROM d JOIN ends USING (series_key) UNION ALL
SELECT series_key, strftime(last + to_hours(CAST(i AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ds FROM ends, range(1, 49) AS r(i)""",
    ),
    "ts5_future_days": over(LI, _days(90, 7, False)),
    "ts6_forecast_days": over(LI, _days(60, 14, False)),
    "ts8_forecast_by_hour": over(
        EV,
        _level("store_location", m())
        + """SELECT CAST(hour(last + to_hours(CAST(i AS INTEGER))) AS INTEGER) AS hour,
          round(CAST(sum(CAST(yhat AS DECIMAL(38, 9))) AS DOUBLE), 6) AS yhat
        FROM level, range(1, 25) AS r(i) GROUP BY 1""",
    ),
    "ts8_forecast_table": over(
        EV,
        _level("'All Stores'", q())
        + """SELECT strftime(last + to_hours(CAST(i AS INTEGER)), '%Y-%m-%d %H:%M') AS "DateTime",
          format('{:,.0f}', yhat) AS "Forecasted Value" FROM level, range(1, 13) AS r(i)""",
    ),
}

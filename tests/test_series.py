"""Series, gaps and forecasts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillmark.functions.fits import arima_212, seasonal_fit
from tillmark.operators import series

HOUR = "2024-01-01 {:02d}:{:02d}:00"


def test_gaps_are_zero_and_forecast_is_flat(sell):
    sales = sell([(HOUR.format(1, 10), 1, 1, "a", "x"), (HOUR.format(4, 20), 2, 1, "a", "x")])
    filled = series.resample(sales, "transaction_qty").orderBy("ds").collect()
    assert [r["y"] for r in filled] == [1, 0, 0, 2]
    got = series.moving_average(sales, "transaction_qty", periods=2).orderBy("ds").collect()
    assert [str(r["ds"]) for r in got] == ["2024-01-01 05:00:00", "2024-01-01 06:00:00"]
    assert [r["yhat"] for r in got] == pytest.approx([2 / 3, 2 / 3])


def test_two_hours_are_too_few(sell):
    sales = sell([(HOUR.format(1, 10), 1, 1, "a", "x"), (HOUR.format(2, 20), 2, 1, "a", "x")])
    assert series.moving_average(sales).count() == 0


def test_every_series_has_its_own_forecast(sell):
    sales = sell([(HOUR.format(h, 0), q, 1, s, "x") for s, q in (("a", 3), ("b", 6)) for h in (1, 2, 3)])
    got = series.moving_average(sales, "transaction_qty", ["store_location"], 4)
    assert {(r["series_key"], r["yhat"]) for r in got.collect()} == {("a", 3.0), ("b", 6.0)}
    assert got.count() == 8


def test_hour_sums_stand_in_for_transactions(sell):
    sales = sell([(HOUR.format(h, m), 2, 3, "a", "x") for h in (1, 2, 5) for m in (0, 30)])
    hours = series.hour_sums(sales)
    for target in ("revenue", "transaction_qty"):
        want = series.resample(sales, target).orderBy("ds").collect()
        assert series.resample(hours, target).orderBy("ds").collect() == want
    got = series.moving_average_kpis(sales).first()
    assert tuple(got) == (12 * 12 / 3.0, "01:00 AM", int(12 * 12 / 3 / 6))


def daily(sell, values, store="a"):
    start = pd.Timestamp("2023-01-01 12:00:00")
    return [(str(start + pd.Timedelta(days=i)), v, 1, store, "x") for i, v in enumerate(values)]


def test_seasonal_bands_and_horizon(spark, sell):
    rng = np.random.default_rng(1)
    t = np.arange(730)
    truth = 100 * np.exp(0.0005 * t + 0.2 * np.sin(2 * np.pi * t / 7))
    sales = sell(daily(sell, np.round(truth * np.exp(rng.normal(0, 0.02, 730)), 2)))
    got = series.seasonal_forecast(sales, "transaction_qty", periods=28)
    future = series.future_only(got).orderBy("ds").toPandas()
    ahead = np.arange(730, 758)
    expected = 100 * np.exp(0.0005 * ahead + 0.2 * np.sin(2 * np.pi * ahead / 7))
    assert len(future) == 28 and str(future["ds"].iloc[0])[:10] == "2024-12-31"
    assert np.abs(future["yhat"] / expected - 1).mean() < 0.05
    assert (future["yhat_lower"] <= future["yhat"]).all() and (future["yhat"] <= future["yhat_upper"]).all()
    inside = got.where("not is_future").select(F.count("*")).first()[0]
    assert inside == 730
    totals = series.forecast_totals(series.future_only(got)).first()
    assert totals["daily_mean"] == pytest.approx(totals["forecast_total"] / 28)


def test_short_histories_are_left_out(sell):
    rows = daily(sell, [5] * 6, "six") + daily(sell, range(1, 9), "eight") + daily(sell, range(1, 16), "fifteen")
    sales = sell(rows)
    by = ["store_location"]
    seasonal = {r[0] for r in series.seasonal_forecast(sales, "transaction_qty", by).select("series_key").collect()}
    arima = {r[0] for r in series.arima_forecast(sales, "transaction_qty", by).select("series_key").collect()}
    assert (seasonal, arima) == ({"eight", "fifteen"}, {"fifteen"})


def test_days_without_sales_do_not_enter_the_fits(sell):
    values = [5] * 13 + [0] * 5
    assert series.arima_forecast(sell(daily(sell, values)), "transaction_qty").count() == 0


def test_constant_series(sell):
    sales = sell(daily(sell, [7] * 30))
    flat = series.arima_forecast(sales, "transaction_qty", periods=5).collect()
    assert [r["yhat"] for r in flat] == pytest.approx([7] * 5)
    seasonal = series.future_only(series.seasonal_forecast(sales, "transaction_qty", periods=5)).collect()
    assert [r["yhat"] for r in seasonal] == pytest.approx([7] * 5, rel=1e-3)


def test_arima_recovers_known_coefficients():
    rng = np.random.default_rng(5)
    n, e = 6000, rng.normal(0, 1, 6000)
    w = np.zeros(n)
    for i in range(2, n):
        w[i] = 0.5 * w[i - 1] - 0.3 * w[i - 2] + e[i] + 0.4 * e[i - 1]
    y = 1000 + np.cumsum(w)
    got = np.diff(np.r_[y[-1], arima_212(y, 3)[0]])
    first = 0.5 * w[-1] - 0.3 * w[-2] + 0.4 * e[-1]
    second = 0.5 * first - 0.3 * w[-1]
    assert got[:2] == pytest.approx([first, second], abs=0.15)


def test_seasonal_fit_is_finite_on_the_shortest_history():
    bands = seasonal_fit(np.arange(7.0), np.array([3, 1, 4, 1, 5, 9, 2.0]), np.arange(7.0, 37), 1.96)
    assert bands.shape == (37, 3) and np.isfinite(bands).all()


@pytest.mark.parametrize("history,ahead", [(60, 90), (180, 90), (14, 30)])
def test_a_straight_line_goes_on(history, ahead):
    days = np.arange(float(history + ahead))
    line = 100 + 10 * days
    future = seasonal_fit(days[:history], line[:history], days[history:], 1.96)[history:, 0]
    assert future == pytest.approx(line[history:], rel=0.1)


@pytest.mark.parametrize("noise", [0.3, 0.6, 0.9])
def test_fitted_values_are_means(noise):
    rng = np.random.default_rng(3)
    days = np.arange(700.0)
    y = 200 * np.exp(rng.normal(0, noise, 700))
    assert seasonal_fit(days, y, days[:0], 1.96)[:, 0].sum() == pytest.approx(y.sum(), rel=0.02)


def test_trend_weekday_and_year_are_recovered():
    rng = np.random.default_rng(4)
    days = np.arange(1200.0)
    trend = 100 + 0.2 * days + 0.3 * np.maximum(0, days - 400)
    truth = trend * (1 + 0.3 * np.sin(2 * np.pi * days / 7) + 0.2 * np.cos(2 * np.pi * days / 365.25))
    fit = seasonal_fit(days[:1100], truth[:1100] * (1 + rng.normal(0, 0.05, 1100)), days[1100:], 1.96)
    assert np.abs(fit[:, 0] / truth - 1).mean() < 0.02
    assert np.abs(fit[1100:, 0] / truth[1100:] - 1).mean() < 0.05


def test_hours_have_a_daily_season(sell):
    start = pd.Timestamp("2024-01-01")
    values = [100 + 60 * np.sin(2 * np.pi * h / 24) for h in range(24 * 28)]
    sales = sell([(str(start + pd.Timedelta(hours=h)), v, 1, "a", "x") for h, v in enumerate(values)])
    got = series.seasonal_forecast(sales, "transaction_qty", periods=24, freq="hour")
    future = series.future_only(got).orderBy("ds").toPandas()
    assert str(future["ds"].iloc[0]) == "2024-01-29 00:00:00"
    assert future["yhat"].to_numpy() == pytest.approx(values[:24], rel=0.05)


def test_a_sentinel_date_is_an_error(sell):
    sales = sell([(HOUR.format(1, 0), 1, 1, "a", "x"), ("9999-12-31 00:00:00", 1, 1, "a", "x")])
    with pytest.raises(Exception, match="years without sales"):
        series.resample(sales).collect()


def test_comparison_has_all_models(sell):
    sales = sell(daily(sell, range(1, 40)))
    got = series.compare_forecasts(sales, "transaction_qty")
    assert {r["Model"]: r["Horizon"] for r in got.collect()} == {
        "Moving Average": "12h", "Seasonal Trend": "30d", "ARIMA": "14d"
    }


def test_names_of_longer_keys_stay_unique(sell):
    time = HOUR.format(1, 0)
    sales = sell([(time, 1, 1, "a / b", "c"), (time, 2, 1, "a", "b / c"), (time, 4, 1, "a", None)])
    got = series.bucket_sums(sales, "transaction_qty", "hour", ["store_location", "product_category"])
    assert sorted(r["y"] for r in got.collect()) == [1.0, 2.0]


def test_fits_share_one_partitioning(sell):
    plan = series.arima_forecast(sell(daily(sell, range(1, 30))), "transaction_qty", ["store_location"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(series_key") == 1
    assert "REPARTITION_BY_NUM" in text


def changing(rng, n, rate, size, noise):
    """A line whose slope changes now and then."""
    slopes, slope = np.zeros(n), rng.normal(0, size)
    for i in range(n):
        slope = rng.normal(0, size) if rng.random() < rate else slope
        slopes[i] = slope
    return 100 + np.cumsum(slopes) + rng.normal(0, noise, n)


def covered(make, count, history, ahead=60):
    rng, shares = np.random.default_rng(history), []
    for _ in range(count):
        y, days = make(rng, history + ahead), np.arange(float(history + ahead))
        low, high = seasonal_fit(days[:history], y[:history], days[history:], 1.96)[history:, 1:].T
        shares.append(((low <= y[history:]) & (y[history:] <= high)).mean())
    return np.mean(shares)


@pytest.mark.parametrize("history, rate, size, noise", [(730, 0.02, 0.3, 3), (730, 0.01, 1, 5), (200, 0.01, 1, 5), (400, 0.01, 1, 5)])
def test_bands_cover_changes_of_the_slope(history, rate, size, noise):
    assert covered(lambda rng, n: changing(rng, n, rate, size, noise), 30, history) >= 0.88


@pytest.mark.parametrize("history", [60, 400])
def test_bands_cover_plain_noise(history):
    assert 0.9 <= covered(lambda rng, n: 100 + rng.normal(0, 5, n), 20, history) <= 0.99


@pytest.mark.parametrize("history,ahead", [(60, 90), (180, 90), (14, 30), (400, 60)])
def test_a_straight_line_goes_on_within_a_hundredth(history, ahead):
    days = np.arange(float(history + ahead))
    line = 100 + 10 * days
    assert seasonal_fit(days[:history], line[:history], days[history:], 1.96)[history:, 0] == pytest.approx(line[history:], rel=0.01)


def test_two_weeks_of_a_random_walk():
    """A forecast from 14 days is not much worse than the last value, not on the worst of 200 walks either."""
    rng = np.random.default_rng(0)
    walks = 100 + np.cumsum(rng.normal(0, 1, (200, 28)), 1)
    errors = np.array([np.abs(arima_212(y[:14], 14)[0] - y[14:]).mean() for y in walks])
    last = np.abs(walks[:, 13:14] - walks[:, 14:]).mean(1)
    assert errors.mean() < 1.1 * last.mean() and errors.max() < 1.5 * last.max()


def test_deviations_of_the_forecast():
    """95 % of the values of known processes lie within 1.96 deviations, near and far."""
    rng, inside = np.random.default_rng(2), []
    for _ in range(60):
        e = rng.normal(0, 1, 230)
        w = np.zeros(230)
        for i in range(2, 230):
            w[i] = 0.5 * w[i - 1] - 0.3 * w[i - 2] + e[i] + 0.4 * e[i - 1]
        y = np.cumsum(w)
        level, deviation = arima_212(y[:200], 30)
        inside.append(np.abs(y[200:] - level) < 1.96 * deviation)
    assert 0.88 < np.mean(inside) < 0.99

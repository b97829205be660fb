"""Small fits of one series of buckets, used inside grouped Pandas functions."""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle

# Ship these functions with the task, so executors do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGEPOINTS = 48
CHANGEPOINT_RANGE = 0.96
CHANGEPOINT_SCALE = 0.05
#: Period in days and number of waves of the seasons, and how large they are before seeing data.
YEAR, WEEK, DAY = (365.25, 10), (7.0, 3), (1.0, 4)
SEASON_SCALE = 0.2
ROUNDS = 60
#: Changes of slope below this share of the largest one (or of the prior's scale) count as none.
LEAST_CHANGE = 0.02
PATHS = 1000
#: Typical sizes of a change of slope that are compared; the first one is none.
SCALES = np.r_[1e-6, np.geomspace(1e-3, 3, 18)]
#: Days that a test of the bands takes at least, how many tests there are, and by how much they may widen bands.
LEAST_TEST, TESTS, MOST_WIDENING = 10, 4, 4.0


def _trend(days: np.ndarray, start: float, span: float) -> np.ndarray:
    """A line with hinges in the first part of the history."""
    t = (days - start) / span
    hinges = np.linspace(0, CHANGEPOINT_RANGE, CHANGEPOINTS + 1)[1:]
    return np.column_stack([np.ones_like(t), t, np.maximum(0, t[:, None] - hinges)])


def _waves(days: np.ndarray, daily: bool) -> np.ndarray:
    seasons = [YEAR, WEEK, DAY] if daily else [YEAR, WEEK]
    return np.column_stack(
        [wave(2 * np.pi * k * days / period) for period, terms in seasons for k in range(1, terms + 1) for wave in (np.sin, np.cos)]
    )


def seasonal_fit(days: np.ndarray, y: np.ndarray, ahead: np.ndarray, z: float, daily: bool = False) -> np.ndarray:
    """``yhat, lower, upper`` for the history and the days ``ahead``, see ``seasonal_bands``. Bands ahead are widened by what
    forecasts of late parts of the history, each from the part before it, show them to lack."""
    bands = seasonal_bands(days, y, ahead, z, daily)
    tested = min(len(ahead), len(days) // 8)
    if tested < LEAST_TEST:
        return bands
    missed = []
    for known in (len(days) - tested * i for i in range(1, TESTS + 1)):
        own = slice(known, known + tested)
        before = seasonal_bands(days[:known], y[:known], days[own], z, daily)[known:]
        half = np.maximum((before[:, 2] - before[:, 1]) / 2, 1e-300)
        missed.append(np.abs(y[own] - before[:, 0]) / half)
    # Few tests see few changes, so what counts is nearly the worst day.
    missed = np.quantile(np.concatenate(missed), (1 + math.erf(z / math.sqrt(2))) / 2)
    wider = min(max(missed, 1.0), MOST_WIDENING)
    future = bands[len(days) :]
    future[:, 1] = future[:, 0] - wider * (future[:, 0] - future[:, 1])
    future[:, 2] = future[:, 0] + wider * (future[:, 2] - future[:, 0])
    return bands


def seasonal_bands(days: np.ndarray, y: np.ndarray, ahead: np.ndarray, z: float, daily: bool) -> np.ndarray:
    """Linear trend with hinges, times one plus the seasons: yhat, lower, upper for the history and
    the days ``ahead``. ``yhat`` is the mean.

    Both factors are linear in their own coefficients, so they are fitted in turn, each with the other
    one fixed, until the values no longer change. Changes of slope have a Laplace prior, as a mixture of normal ones whose
    widths follow the last values, so most become zero; those that stay are fitted once more without it. How large changes
    typically are is the size under which the series is likeliest; it decides how sure the last slope is. The band of the days
    ahead comes from simulated futures, where the slope goes on to change by that much wherever a hinge would follow.
    """
    start, span = days[0], max(days[-1] - days[0], 1.0)
    scale = np.abs(y).max() or 1.0
    trend, waves, target = _trend(days, start, span), _waves(days, daily), y / scale
    season, fitted = np.zeros_like(target), np.zeros_like(target)
    noise = max(target.var(), 1e-6)
    width = np.full(CHANGEPOINTS, CHANGEPOINT_SCALE)
    # A yearly season cannot be told from the trend before two years have been seen.
    yearly = min(1.0, span / (2 * YEAR[0])) ** 2
    wave_prior = np.full(waves.shape[1], SEASON_SCALE)
    wave_prior[: 2 * YEAR[1]] *= yearly
    changing = np.r_[False, False, np.ones(CHANGEPOINTS, bool), np.zeros(waves.shape[1], bool)]

    def ridge(x: np.ndarray, values: np.ndarray, prior: np.ndarray) -> np.ndarray:
        return np.linalg.solve(x.T @ x + np.diag(noise / prior**2), x.T @ values)

    for sparse in (True, False):
        for _ in range(ROUNDS):
            line = ridge(trend * (1 + season)[:, None], target, np.r_[10.0, 10.0, width])
            if sparse:
                # The mean of 1 / width^2 given a change d is 1 / (scale |d|).
                width = np.sqrt(CHANGEPOINT_SCALE * np.maximum(np.abs(line[2:]), 1e-7))
            base = trend @ line
            wave = ridge(waves * base[:, None], target - base, wave_prior)
            season = waves @ wave
            before, fitted = fitted, base * (1 + season)
            noise = max(np.mean((target - fitted) ** 2), 1e-10)
            if np.abs(fitted - before).max() < 1e-7:
                break
        # Both factors together, linear around the fit.
        joint = np.column_stack([trend * (1 + season)[:, None], waves * base[:, None]])
        prior = np.r_[10.0, 10.0, width, wave_prior]
        used = _effective(joint, noise, prior)
        noise *= len(target) / max(len(target) - used, len(target) / 4)
        if sparse:
            typical = _likely_scale(joint, target - fitted + joint @ np.r_[line, wave], noise, prior, changing)
            width = np.full(CHANGEPOINTS, typical)
    spread = np.linalg.inv(joint.T @ joint + np.diag(noise / prior**2))
    where = np.r_[days, ahead]
    trend, waves = _trend(where, start, span), _waves(where, daily)
    base, season = trend @ line, waves @ wave
    joint = np.column_stack([trend * (1 + season)[:, None], waves * base[:, None]])
    error = np.sqrt(noise * (1 + np.maximum(np.einsum("ij,jk,ik->i", joint, spread, joint), 0)))
    center = base * (1 + season)
    low, high = center - z * error, center + z * error
    if len(ahead) and typical > SCALES[0]:
        paths = _slope_changes((ahead - start) / span, typical) * (1 + season[len(days) :])
        paths += center[len(days) :] + error[len(days) :] * np.random.default_rng(11).standard_normal(paths.shape)
        share = math.erf(z / math.sqrt(2))
        low[len(days) :], high[len(days) :] = np.quantile(paths, [(1 - share) / 2, (1 + share) / 2], axis=0)
        low, high = np.minimum(low, center), np.maximum(high, center)
    return scale * np.column_stack([center, low, high])


def _effective(x: np.ndarray, noise: float, prior: np.ndarray) -> float:
    """How many coefficients a ridge regression really uses."""
    gram = x.T @ x
    return float(np.trace(np.linalg.solve(gram + np.diag(noise / prior**2), gram)))


def _likely_scale(x: np.ndarray, values: np.ndarray, noise: float, prior: np.ndarray, of: np.ndarray) -> float:
    """The common prior width of the coefficients ``of`` under which the values are likeliest."""
    gram, both = x.T @ x, x.T @ values
    best, found = -np.inf, SCALES[0]
    for scale in SCALES:
        width = np.where(of, scale, prior)
        inner = gram * width[:, None] * width[None, :] / noise + np.eye(len(width))
        explained = (both * width) @ np.linalg.solve(inner, both * width) / noise**2
        evidence = 0.5 * (explained - np.linalg.slogdet(inner)[1])
        if evidence > best:
            best, found = evidence, scale
    return float(found)


def _slope_changes(t: np.ndarray, scale: float) -> np.ndarray:
    """What changes of slope after the last hinge add to the trend at times ``t``, in simulated futures."""
    step = CHANGEPOINT_RANGE / CHANGEPOINTS
    places = np.arange(CHANGEPOINT_RANGE + step, t[-1], step)
    drawn = np.random.default_rng(10).laplace(0, scale / math.sqrt(2), (PATHS, len(places)))
    return drawn @ np.maximum(0, t[None, :] - places[:, None])


# --- ARIMA(2,1,2) by its likelihood -------------------------------------------------------------

#: Observations the prior of no autocorrelation counts for: it decides on two weeks and hardly matters after a year.
PRIOR = 6.0


def arma_state(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, noise loading and stationary covariance of the states of ARMA(2,2) processes (one per row of coefficients)."""
    k = len(ar)
    move, load = np.zeros((k, 3, 3)), np.ones((k, 3))
    move[:, 0, 0], move[:, 1, 0], move[:, 0, 1], move[:, 1, 2] = ar[:, 0], ar[:, 1], 1, 1
    load[:, 1:] = ma
    noise = load[:, :, None] * load[:, None, :]
    square = np.einsum("kij,klm->kiljm", move, move).reshape(k, 9, 9)
    start = np.linalg.solve(np.eye(9) - square, noise.reshape(k, 9, 1)).reshape(k, 3, 3)
    return move, noise, start


def kalman(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of coefficients: the log likelihood of ``w`` at its best shock variance, that variance, and the state after the last value."""
    move, noise, spread = arma_state(ar, ma)
    state = np.zeros((len(ar), 3))
    squares, logs = np.zeros(len(ar)), np.zeros(len(ar))
    turned = move.transpose(0, 2, 1)
    steady = False
    for value in w:
        if not steady:
            width = spread[:, 0, 0]
            gain = spread[:, :, 0] / width[:, None]
            after = spread - gain[:, :, None] * spread[:, None, 0, :]
            following = move @ after @ turned + noise
            steady = np.abs(following - spread).max() < 1e-13
            spread = following
        error = value - state[:, 0]
        squares += error * error / width
        logs += np.log(width)
        state = np.einsum("kij,kj->ki", move, state + gain * error[:, None])
    variance = np.maximum(squares / len(w), 1e-300)
    return -0.5 * (len(w) * (np.log(2 * np.pi * variance) + 1) + logs), variance, state


def _coefficients(free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stationary and invertible coefficients of free numbers, by partial autocorrelations."""
    part = np.tanh(free)

    def stable(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.column_stack([a * (1 - b), b])

    return stable(part[:, 0], part[:, 1]), -stable(part[:, 2], part[:, 3])


def arima_fit(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of ARMA(2,2) of the differences ``w`` with the largest posterior."""

    def cost(free: np.ndarray) -> np.ndarray:
        free = np.clip(free, -3.5, 3.5)
        return -kalman(w, *_coefficients(free))[0] + 0.5 * PRIOR * (free * free).sum(1)

    starts = np.array([[0, 0, 0, 0], [0.5, 0, -0.3, 0], [-0.5, 0, 0.3, 0], [0.3, -0.5, 0.3, 0.3], [0.8, 0, -0.8, 0.0], [0, 0, -0.6, 0]], float)
    at = starts[np.argmin(cost(starts))]
    inverse, step = np.eye(4), 1e-4
    before = None
    for _ in range(60):
        near = np.concatenate([[at], at + step * np.eye(4), at - step * np.eye(4)])
        values = cost(near)
        slope = (values[1:5] - values[5:]) / (2 * step)
        if before is not None:  # Broyden, Fletcher, Goldfarb and Shanno's update of the inverse curvature
            moved, turned = at - before[0], slope - before[1]
            dot = moved @ turned
            if dot > 1e-12:
                left = np.eye(4) - np.outer(moved, turned) / dot
                inverse = left @ inverse @ left.T + np.outer(moved, moved) / dot
        way = -inverse @ slope
        if way @ slope >= 0:
            inverse, way = np.eye(4), -slope
        way *= min(1.0, 1.5 / max(np.abs(way).max(), 1e-12))
        tries = at + np.array([2.0, 1, 0.5, 0.25, 0.06, 0.01, 0.001])[:, None] * way
        costs = cost(tries)
        best = int(np.argmin(costs))
        if costs[best] > values[0] - 1e-9 * (1 + abs(values[0])):
            break
        before, at = (at, slope), tries[best]
    ar, ma = _coefficients(np.clip(at, -3.5, 3.5)[None])
    return ar[0], ma[0]


def arima_forecast_with(y: np.ndarray, ar: np.ndarray, ma: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Forecast of the coming values, their standard deviations, and the log likelihood, with given coefficients."""
    w = np.diff(y)
    likelihood, variance, state = kalman(w, ar[None], ma[None])
    move = arma_state(ar[None], ma[None])[0][0]
    now, changes = state[0], []
    for _ in range(ahead):
        changes.append(now[0])
        now = move @ now
    # Weights of the shocks to come: of a change, and summed up, of the level.
    now, weights = np.r_[1.0, ma], []
    for _ in range(ahead):
        weights.append(now[0])
        now = move @ now
    levels = np.cumsum(weights)
    return y[-1] + np.cumsum(changes), np.sqrt(variance[0] * np.cumsum(levels**2)), float(likelihood[0])


def arima_212(y: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """ARIMA(2,1,2) forecast and its standard deviations, by exact likelihood (Kalman filter).

    Coefficients are stationary and invertible; a weak prior, worth ``PRIOR`` observations, pulls them to zero, where
    the forecast is the last value.
    """
    w = np.diff(y)
    scale = w.std()
    if scale < 1e-12 * max(np.abs(y).max(), 1e-300):  # the same step every day
        return y[-1] + (w[-1] if len(w) else 0.0) * np.arange(1, ahead + 1), np.zeros(ahead)
    level, deviation, _ = arima_forecast_with(y / scale, *arima_fit(w / scale), ahead)
    return level * scale, deviation * scale

"""Autoregressions, the level test and moving-average terms against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import frame, series_of, training_table, walk

from foldcast.functions.regression import swept
from foldcast.operators.folds import AUTOREGRESSIVE
from foldcast.operators.shaping import returns
from foldcast.plans.autoregressive import ArSpec, autoregressive_forecasts, autoregressive_split, kpss_by_series, order_search
from foldcast.plans.single_split import SplitSpec
from foldcast.plans.moving_average import ArmaSpec, moving_average_forecasts, moving_average_split, settles

SPEC = AUTOREGRESSIVE.but(
    start_date=None, end_date=None, window_size=60, prediction_length=3, frequency=9, validation_size=2
)


def kpss(v, lags):
    e = v - v.mean()
    n = len(v)
    long_run = e @ e
    for s in range(1, lags + 1):
        long_run += 2 * (1 - s / (lags + 1)) * (e[s:] @ e[:-s])
    return (np.cumsum(e) ** 2).sum() / (n * long_run)


def ols(x, y):
    a = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    return b, ((y - a @ b) ** 2).sum()


def ar_loop(prices, spec, max_p, difference, kpss_lags=3):
    """Plain loop of the default alignment: P+V steps from row e-V."""
    x, y = training_table(prices, spec)
    x, y = np.nan_to_num(x[:, 0]), np.nan_to_num(y)
    n, p_ahead, v = len(y), spec.prediction_length, spec.validation_size
    deepest = 2 if difference is None else difference
    made, model, picked = np.full(n, np.nan), None, []
    for t in range(spec.window_size, n - p_ahead + 1):
        e = t + p_ahead - 1
        if t % spec.frequency == 0:
            oldest = p_ahead + (t - spec.window_size) * spec.sliding_window
            d = difference
            if d is None:
                d = 2
                for k in (0, 1):
                    tested = np.diff(y[oldest : e - v + 1], k)
                    lags = int(3 * np.sqrt(len(tested)) / 13) if kpss_lags is None else kpss_lags
                    if kpss(tested, lags) < 0.463:
                        d = k
                        break
            picked.append(d)
            yd, xd = y[p_ahead:], x[: n - p_ahead]  # pairs by target row
            yd, xd = np.diff(yd, d), np.diff(xd, d)
            off = p_ahead + d  # row of the first differenced pair
            rows = np.arange(oldest + max_p + deepest, e - v + 1) - off
            best = None
            for p in range(max_p + 1):
                b, rss = ols(np.column_stack([xd[rows]] + [yd[rows - a] for a in range(1, p + 1)]), yd[rows])
                aic = len(rows) * np.log(rss / len(rows)) + 2 * (p + 2)
                if best is None or aic < best[0] - 1e-9:
                    best = (aic, p, b)
            model = (d, best[1], best[2])
        if model is None:
            continue
        d, p, b = model
        past = list(y[: e - v + 1])
        for h in range(1, p_ahead + v + 1):
            row = e - v + h
            u = np.diff(x[row - p_ahead - d : row - p_ahead + 1], d)[0]
            lagged = np.diff(np.array(past), d)
            step = b[0] + b[1] * u + sum(b[1 + a] * lagged[-a] for a in range(1, p + 1))
            past.append(step + (0 if d == 0 else past[-1] if d == 1 else 2 * past[-1] - past[-2]))
        made[e] = past[-1]
    landed = np.full(n, np.nan)
    landed[p_ahead:] = made[:-p_ahead]
    return landed[spec.window_size + 2 * p_ahead - 1 :], picked


def drifting(n, seed):
    """Prices whose returns are a random walk, so that they need differencing."""
    rng = np.random.default_rng(seed)
    rates = np.cumsum(rng.normal(0, 0.002, n))
    return 100 * np.cumprod(1 + rates)


@pytest.mark.parametrize("difference", [0, 1, 2])
@pytest.mark.parametrize("block_rows", [1, 5000])
def test_forecasts_equal_the_loop(spark, difference, block_rows):
    prices = walk(200, 21)
    ar = ArSpec(max_p=3, difference=difference)
    got = autoregressive_forecasts(frame(spark, {"a": prices}), SPEC.but(block_rows=block_rows), ar).toPandas()
    want, _ = ar_loop(prices, SPEC, 3, difference)
    np.testing.assert_allclose(series_of(got, "a"), want, rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("lags", [0, 3, None])
@pytest.mark.parametrize("sliding", [False, True])
def test_difference_is_chosen_by_the_level_test(spark, lags, sliding):
    series = {"calm": walk(220, 22), "drift": drifting(220, 23)}
    ar, spec = ArSpec(max_p=2, difference=None, kpss_lags=lags), SPEC.but(sliding_window=sliding)
    got = autoregressive_forecasts(frame(spark, series), spec.but(block_rows=1), ar).toPandas()
    chosen = set()
    for name, prices in series.items():
        want, picked = ar_loop(prices, spec, 2, None, lags)
        chosen |= set(picked)
        np.testing.assert_allclose(series_of(got, name), want, rtol=1e-5, atol=1e-8)
    assert {0, 1} <= chosen


@pytest.mark.parametrize("block_rows", [7, 5000])
def test_level_test(spark, block_rows):
    series = {"calm": walk(150, 24), "drift": drifting(150, 25)}
    numbered = returns(frame(spark, series))
    got = {r.series_id: r for r in kpss_by_series(numbered, "ret", 5, block_rows).collect()}
    for name, prices in series.items():
        r = np.concatenate([[0.0], prices[1:] / prices[:-1] - 1])
        assert got[name].statistic == pytest.approx(kpss(r, 5), rel=1e-9)
    assert got["calm"].stationary == 1 and got["drift"].stationary == 0


def inside(a):
    """All roots of z^m + a1 z^(m-1) + ... inside the unit circle."""
    return not len(a) or np.abs(np.roots(np.r_[1.0, a])).max(initial=0.0) < 1.0


@pytest.mark.parametrize("block_rows", [1, 5000])
@pytest.mark.parametrize("sliding", [False, True])
def test_moving_average_equals_two_regressions(spark, block_rows, sliding):
    prices, spec = walk(190, 26), SPEC.but(block_rows=block_rows, sliding_window=sliding)
    arma = ArmaSpec(max_p=2, max_q=2, max_order=3, long_order=4)
    got = moving_average_forecasts(frame(spark, {"a": prices}), spec, arma).toPandas()
    x, y = training_table(prices, spec)
    x, y = np.nan_to_num(x[:, 0]), np.nan_to_num(y)
    n, p_ahead, v, m, q_max = len(y), 3, 2, 4, 2
    xl = np.concatenate([np.zeros(p_ahead), x[:-p_ahead]])  # input that goes with a target row
    made, model = np.full(n, np.nan), None
    for t in range(60, n - p_ahead + 1):
        e = t + p_ahead - 1
        if t % 9 == 0:
            rows = np.arange(p_ahead + m + q_max + (t - 60) * sliding, e - v + 1)
            long, _ = ols(np.column_stack([xl[rows]] + [y[rows - a] for a in range(1, m + 1)]), y[rows])
            best = None
            for p in range(3):
                for q in range(min(2, 3 - p) + 1):
                    res = lambda r: y[r] - long[0] - long[1] * xl[r] - sum(long[1 + a] * y[r - a] for a in range(1, m + 1))
                    cols = [xl[rows]] + [y[rows - a] for a in range(1, p + 1)] + [res(rows - j) for j in range(1, q + 1)]
                    b, rss = ols(np.column_stack(cols), y[rows])
                    if not (inside(-b[2 : 2 + p]) and inside(b[2 + p :])):
                        continue
                    key = (round(len(rows) * np.log(rss / len(rows)) + 2 * (p + q + 2), 9), p + q, p)
                    if best is None or key < best[0]:
                        best = (key, p, q, b)
            model = (long, *best[1:])
        if model is None:
            continue
        long, p, q, b = model
        s = e - v
        res = [y[s - j] - long[0] - long[1] * xl[s - j] - sum(long[1 + a] * y[s - j - a] for a in range(1, m + 1)) for j in range(q_max)]
        past, errors = list(y[: s + 1]), list(res)
        for h in range(1, p_ahead + v + 1):
            value = b[0] + b[1] * x[s + h - p_ahead]
            value += sum(b[1 + a] * past[-a] for a in range(1, p + 1))
            value += sum(b[1 + p + j] * errors[j - 1] for j in range(1, q + 1))
            past.append(value)
            errors = [0.0] + errors
        made[e] = past[-1]
    want = np.full(n, np.nan)
    want[p_ahead:] = made[:-p_ahead]
    np.testing.assert_allclose(series_of(got, "a"), want[60 + 2 * p_ahead - 1 :], rtol=1e-6, atol=1e-8)


def test_settling_orders(spark):
    rng = np.random.default_rng(5)
    cases = [[0.5], [1.1], [-2.0], [0.0, 0.0], [], [1.0], *[rng.normal(0, 0.6, rng.integers(1, 6)).tolist() for _ in range(200)]]
    cases += [[*c, 0.0, 0.0] for c in cases]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, a array<double>")
    got = [r.ok for r in df.select("k", settles(F.col("a")).alias("ok")).orderBy("k").collect()]
    assert got == [bool(inside(c)) for c in cases] and any(got) and not all(got)


@pytest.mark.parametrize("block_rows", [5, 5000])
def test_single_split_with_errors_runs_from_the_end_of_training(spark, block_rows):
    rng = np.random.default_rng(12)
    shocks = rng.normal(0, 0.02, 301)
    prices = 100 * np.cumprod(1 + np.r_[0.0, shocks[1:] + 0.7 * shocks[:-1]][:300])
    arma = ArmaSpec(max_p=2, max_q=2, max_order=3, long_order=4)
    got = series_of(moving_average_split(frame(spark, {"a": prices}), arma, SplitSpec(lags=1, block_rows=block_rows)).toPandas(), "a")
    y = np.r_[0.0, prices[1:] / prices[:-1] - 1]
    kept = 300 - 30
    n_fit = kept - int(np.ceil(0.15 * kept))
    rows = np.arange(6, n_fit)
    # the input is the first own lag, which adds nothing beside it
    long, _ = ols(np.column_stack([y[rows - a] for a in range(1, 5)]), y[rows])
    error = lambda r: y[r] - long[0] - sum(long[a] * y[r - a] for a in range(1, 5))
    best = None
    for p in range(3):
        for q in range(min(2, 3 - p) + 1):
            cols = [y[rows - 1]] + [y[rows - a] for a in range(2, p + 1)] + [error(rows - j) for j in range(1, q + 1)]
            b, rss = ols(np.column_stack(cols), y[rows])
            own, theta = b[2 : 2 + max(p - 1, 0)], b[2 + max(p - 1, 0) :]
            phi = np.r_[np.zeros(min(p, 1)), own]
            if not (inside(-phi) and inside(theta)):
                continue
            key = (round(len(rows) * np.log(rss / len(rows)) + 2 * (p + q + 2), 9), p + q, p)
            if best is None or key < best[0]:
                best = (key, b[0], b[1], phi, theta)
    _, c, beta, phi, theta = best
    assert len(theta), "the series has an error term"
    past, errors = list(y[:n_fit]), [error(n_fit - j) for j in (1, 2)]
    for k in range(n_fit, 300):
        past.append(c + beta * y[k - 1] + sum(f * past[-a] for a, f in enumerate(phi, 1)) + sum(t * e for t, e in zip(theta, errors)))
        errors = [0.0, errors[0]]
    np.testing.assert_allclose(got, past[kept:], atol=1e-9)


@pytest.mark.parametrize("block_rows", [4, 5000])
def test_single_split_forecasts_run_from_the_end_of_training(spark, block_rows):
    prices = walk(160, 27)
    split = SplitSpec(lags=1, block_rows=block_rows)
    got = series_of(autoregressive_split(frame(spark, {"a": prices}), ArSpec(max_p=3), split).toPandas(), "a")
    y = np.concatenate([[0.0], prices[1:] / prices[:-1] - 1])
    kept = 160 - 16
    n_fit = kept - int(np.ceil(0.15 * kept))
    x = np.concatenate([[0.0], y[:-1]])
    rows, best = np.arange(3, n_fit), None
    for p in range(4):  # the first own lag equals the input and adds nothing
        cols = [x[rows]] + [y[rows - a] for a in range(2, p + 1)]
        b, rss = ols(np.column_stack(cols), y[rows])
        aic = len(rows) * np.log(rss / len(rows)) + 2 * (p + 2)
        if best is None or aic < best[0] - 1e-9:
            best = (aic, p, b)
    _, p, b = best
    past = list(y[:n_fit])
    for k in range(n_fit, 160):
        past.append(b[0] + b[1] * x[k] + sum(b[a] * past[-a] for a in range(2, p + 1)))
    np.testing.assert_allclose(got, past[kept:], atol=1e-9)


def test_matrix_of_nested_fits_is_made_once(spark):
    """Whatever makes the matrix of a sweep, or the fits of every order, must not run again for each use."""
    assert str(swept(F.col("the_matrix"), 7, list(range(6)))).count("the_matrix") == 1
    prices = spark.createDataFrame([("a", k, 1.0 + (k * 7 % 11)) for k in range(60)], "series_id string, k int, price double")
    prices = prices.selectExpr("series_id", "date_add(DATE'2020-01-01', k) AS dt", "price")
    found = order_search(prices, ArSpec())
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("aggregate(") == 1
    assert found.where("chosen = 1").count() == 1 and found.count() == 6

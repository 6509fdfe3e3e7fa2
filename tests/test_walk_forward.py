"""Frames against a plain loop, and properties every fold must have."""

import numpy as np
import pytest
from helpers import frame, least_squares, loop_forecasts, series_of, walk

from foldcast.operators.folds import LINEAR
from foldcast.plans.walk_forward import linear_forecasts, tube_forecasts

SMALL = LINEAR.but(start_date=None, end_date=None, window_size=40, prediction_length=4, validation_size=3)


def awkward():
    """Gaps, a zero price, and unequal lengths."""
    a, b, c = walk(160, 1), walk(131, 2), walk(47, 3)
    a[[0, 1, 20, 21, 90]] = np.nan
    b[60] = 0.0
    return {"a": a, "b": b, "c": c, "flat": np.full(120, 7.0)}


CASES = {
    "every_row": {},
    "weekly": {"frequency": 7},
    "two_lags": {"lags": 2, "frequency": 3},
    "three_lags": {"lags": 3},
    "four_lags": {"lags": 4, "frequency": 5},
    "growing": {"sliding_window": False, "frequency": 5},
    "no_validation": {"validation_size": 0},
    "long_returns": {"input_pct_change": 3, "output_pct_change": 2},
    "small_blocks": {"block_rows": 1, "frequency": 7},
    "small_blocks_growing": {"block_rows": 1, "frequency": 7, "sliding_window": False, "lags": 2},
}


@pytest.mark.parametrize("case", CASES)
def test_equals_the_loop(spark, case):
    spec = SMALL.but(**CASES[case])
    series = awkward()
    got = linear_forecasts(frame(spark, series), spec).toPandas()
    first = spec.window_size + 2 * spec.prediction_length - 1
    for name, prices in series.items():
        pred, true = loop_forecasts(prices, spec, least_squares)
        np.testing.assert_allclose(series_of(got, name), pred[first:], rtol=1e-8, atol=1e-9)
        np.testing.assert_allclose(series_of(got, name, "true"), true[first:], rtol=1e-9)


@pytest.mark.parametrize("growing", [False, True])
def test_tube_is_the_midrange_of_the_fold(spark, growing):
    spec = SMALL.but(sliding_window=not growing, block_rows=1)
    prices = walk(150, 4)

    def midrange(x, y):
        inside = y.max() - y.min() <= 0.08
        return lambda row: (y.max() + y.min()) / 2 if inside else np.nan

    got = tube_forecasts(frame(spark, {"a": prices}), spec, epsilon=0.04).toPandas()
    pred, _ = loop_forecasts(prices, spec, midrange)
    first = spec.window_size + 2 * spec.prediction_length - 1
    np.testing.assert_allclose(series_of(got, "a"), pred[first:], atol=1e-12)


def test_constant_input_gives_the_mean(spark):
    growth = 1.01 ** np.arange(120)
    got = linear_forecasts(frame(spark, {"a": growth}), SMALL).toPandas()
    np.testing.assert_allclose(got.pred.astype(float), 0.01, atol=1e-9)


def test_dependent_inputs_give_the_shortest_solution(spark):
    # returns of period 2 or 3: later lags are combinations of the first one or two
    two, three = np.where(np.arange(140) % 2 == 0, 1.1, 0.95), np.array([1.1, 0.95, 1.02])[np.arange(140) % 3]
    for steps, lags in ((two, 2), (two, 3), (two, 5), (three, 4)):
        prices = 10 * np.cumprod(steps)
        spec = SMALL.but(lags=lags)
        got = linear_forecasts(frame(spark, {"a": prices}), spec).toPandas()
        pred, _ = loop_forecasts(prices, spec, least_squares)
        first = spec.window_size + 2 * spec.prediction_length - 1
        np.testing.assert_allclose(series_of(got, "a"), pred[first:], atol=1e-7)


def test_no_look_ahead(spark):
    prices = walk(130, 5)
    later = prices.copy()
    later[100:] *= 3
    got = [
        series_of(linear_forecasts(frame(spark, {"a": p}), SMALL.but(block_rows=1)).toPandas(), "a")
        for p in (prices, later)
    ]
    # the forecast landing on row k was made at row k-P
    first = SMALL.window_size + 2 * SMALL.prediction_length - 1
    same = 100 + SMALL.prediction_length - first
    np.testing.assert_array_equal(got[0][:same], got[1][:same])
    assert not np.allclose(got[0][same:], got[1][same:])


def test_other_series_and_row_order_change_nothing(spark):
    a, b = walk(110, 6), walk(90, 7)
    alone = series_of(linear_forecasts(frame(spark, {"a": a}), SMALL).toPandas(), "a")
    both = linear_forecasts(frame(spark, {"a": a, "b": b}, shuffle=True), SMALL).toPandas()
    np.testing.assert_array_equal(alone, series_of(both, "a"))


def test_growing_equals_sliding_in_the_first_fold(spark):
    px = frame(spark, {"a": walk(110, 8)})
    slide = linear_forecasts(px, SMALL).orderBy("i").first()
    grow = linear_forecasts(px, SMALL.but(sliding_window=False)).orderBy("i").first()
    assert slide.pred == pytest.approx(grow.pred, abs=1e-12)


def test_no_model_before_the_first_refit(spark):
    spec = SMALL.but(window_size=40, frequency=7)
    got = linear_forecasts(frame(spark, {"a": walk(110, 9)}), spec).orderBy("i").collect()
    assert [r.pred is None for r in got[:3]] == [True, True, False]


@pytest.mark.parametrize("infinite,expected", [("drop", None), ("zero", 0.0)])
def test_infinite_target(spark, infinite, expected):
    prices = walk(120, 10)
    prices[80] = 0.0
    got = linear_forecasts(frame(spark, {"a": prices}), SMALL.but(infinite_target=infinite)).collect()
    assert [r.true for r in got if r.i == 81] == [expected]


def test_random_validation_withholds_distinct_rows(spark):
    spec = SMALL.but(random_validation=True, validation_size=9, frequency=4, block_rows=1)
    px = frame(spark, {"a": walk(120, 11)})
    first, again = (series_of(linear_forecasts(px, spec).toPandas(), "a") for _ in range(2))
    np.testing.assert_array_equal(first, again)
    other = series_of(linear_forecasts(px, spec.but(seed=2)).toPandas(), "a")
    assert not np.allclose(first, other)


def test_non_negative_coefficients(spark):
    spec = SMALL.but(lags=3, frequency=4)
    prices = walk(130, 12)

    def best_active_set(x, y):
        mx, my = x.mean(0), y.mean()
        best, beta = np.inf, None
        for mask in range(8):
            on = [k for k in range(3) if mask >> k & 1]
            b = np.zeros(3)
            if on:
                b[on] = np.linalg.lstsq((x - mx)[:, on], y - my, rcond=None)[0]
            rss = ((y - my - (x - mx) @ b) ** 2).sum()
            if (b >= 0).all() and rss < best:
                best, beta = rss, b
        return lambda row: my + (row - mx) @ beta

    got = linear_forecasts(frame(spark, {"a": prices}), spec, positive=True).toPandas()
    pred, _ = loop_forecasts(prices, spec, best_active_set)
    first = spec.window_size + 2 * spec.prediction_length - 1
    np.testing.assert_allclose(series_of(got, "a"), pred[first:], atol=1e-9)

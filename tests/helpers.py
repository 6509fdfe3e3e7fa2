"""Small series, and a plain loop that forecasts them fold by fold."""

import datetime as dt

import numpy as np
import pandas as pd

DAY0 = dt.date(2010, 1, 1)


def frame(spark, series: dict, shuffle: bool = False):
    """Long price table from {name: list of prices}; None is missing."""
    rows = [
        (name, DAY0 + dt.timedelta(days=k), None if p is None or (isinstance(p, float) and np.isnan(p)) else float(p))
        for name, prices in series.items()
        for k, p in enumerate(prices)
    ]
    if shuffle:
        np.random.default_rng(0).shuffle(rows)
        rows = [(str(a), b, None if c is None else float(c)) for a, b, c in rows]
    return spark.createDataFrame(rows, "series_id string, dt date, price double")


def walk(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return 100.0 * np.exp(np.cumsum(rng.normal(0.0, 0.02, n)))


def training_table(prices, spec):
    """Inputs, target, and which targets are infinite, one row per date."""
    s = pd.Series(np.asarray(prices, float)).ffill().dropna().reset_index(drop=True)
    lagged = pd.concat([s.shift(m) for m in range(spec.lags, 0, -1)], axis=1)
    with np.errstate(all="ignore"):
        x = (lagged / lagged.shift(spec.input_pct_change) - 1).to_numpy()
        y = (s / s.shift(spec.output_pct_change) - 1).to_numpy()
    x = np.where(np.isinf(x), 0.0, x)
    return x, y


def loop_forecasts(prices, spec, fit):
    """Forecasts by a plain loop over folds. ``fit(x, y)`` returns a function of one input row."""
    x, y = training_table(prices, spec)
    n, w, p, v = len(y), spec.window_size, spec.prediction_length, spec.validation_size
    made, model = np.full(n, np.nan), None
    for t in range(w, n - p + 1):
        low = t - w if spec.sliding_window else 0
        if t % spec.frequency == 0:
            xs, ys = x[low : t - v], y[low + p : t - v + p]
            keep = ~np.isinf(ys)
            model = fit(np.nan_to_num(xs[keep]), np.nan_to_num(ys[keep]))
        if model is not None:
            made[t + p - 1] = model(x[t + p - 1])
    landed = np.full(n, np.nan)
    landed[p:] = made[:-p]
    return landed, np.where(np.isinf(y), np.nan, y)


def least_squares(x, y):
    mx, my = x.mean(0), y.mean()
    b = np.linalg.lstsq(x - mx, y - my, rcond=1e-10)[0]
    return lambda row: my + (row - mx) @ b


def series_of(result: pd.DataFrame, name: str, column: str = "pred") -> np.ndarray:
    part = result[result.series_id == name].sort_values("dt")
    return part[column].astype(float).to_numpy()

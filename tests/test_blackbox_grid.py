"""Black-box forecasters, settings tables and random validation of growing folds, against plain loops."""

from dataclasses import dataclass

import numpy as np
import pytest
from helpers import frame, least_squares, loop_forecasts, series_of, walk
from pyspark.sql import functions as F

from foldcast.catalog.queries import MeanOfTargets, MedianBySign
from foldcast.operators.folds import LINEAR, random_draw
from foldcast.plans import blackbox, forecaster, grid
from foldcast.plans.walk_forward import linear_forecasts

SPEC = LINEAR.but(start_date=None, end_date=None, window_size=40, prediction_length=4, validation_size=3, frequency=5)


@dataclass(frozen=True)
class TheilSen(blackbox.BlackBox):
    """Median of pairwise slopes."""

    name: str = "theil-sen"

    def train(self, x, y, x_validation, y_validation):
        assert len(x_validation) == len(y_validation) <= 3
        a, b = np.triu_indices(len(y), 1)
        gap = x[a, 0] - x[b, 0]
        slope = np.median((y[a] - y[b])[gap != 0] / gap[gap != 0])
        return np.median(y - slope * x[:, 0]), slope

    def predict(self, model, x):
        return model[0] + model[1] * x[:, 0]


def by_loop(box):
    def fit(x, y):
        model = box.train(x, y, x[:0], y[:0])
        return lambda row: box.predict(model, row[None])[0] if not np.isnan(row).any() else np.nan

    return fit


@pytest.mark.parametrize("block_rows", [30, 5000])
@pytest.mark.parametrize("growing", [False, True])
def test_black_boxes_equal_the_loop(spark, block_rows, growing):
    spec = SPEC.but(block_rows=block_rows, sliding_window=not growing)
    prices = {"a": walk(230, 41), "b": walk(90, 42)}
    prices["b"][20] = 0.0  # an infinite return
    boxes = (TheilSen(), MedianBySign())
    got = blackbox.walk_forward(frame(spark, prices, shuffle=True), spec, *boxes).toPandas()
    for box in boxes:
        for name, series in prices.items():
            want, _ = loop_forecasts(series, spec, by_loop(box))
            np.testing.assert_allclose(series_of(got[got.model == box.name], name), want[spec.window_size + 7 :], atol=1e-9)


def test_black_box_groups_are_bounded(spark):
    with pytest.raises(Exception, match="take sliding windows"):
        blackbox.walk_forward(frame(spark, {"a": walk(200, 1)}), SPEC.but(sliding_window=False), TheilSen(), most_bytes=1000).collect()


def random_loop(spark, prices, spec, fit):
    """Forecasts of folds without the drawn pairs."""
    at = spark.range(len(prices)).select(F.lit("a").alias("series_id"), (F.col("id") - (spec.prediction_length - 1)).alias("t"))
    drawn = {r.t: set(r.held) for r in at.where(f"t >= {spec.window_size}").select("t", random_draw(spec).alias("held")).collect()}
    from helpers import training_table

    x, y = training_table(prices, spec)
    n, w, p = len(y), spec.window_size, spec.prediction_length
    made, model = np.full(n, np.nan), None
    for t in range(w, n - p + 1):
        if t % spec.frequency == 0:
            assert len(drawn[t]) == spec.validation_size
            rows = [j for j in range((t - w if spec.sliding_window else 0) + p, t + p) if j not in drawn[t]]
            model = fit(np.nan_to_num(x[[j - p for j in rows]]), np.nan_to_num(y[rows]))
        if model is not None:
            made[t + p - 1] = model(x[t + p - 1])
    return np.r_[np.full(p, np.nan), made[:-p]][w + 2 * p - 1 :]


@pytest.mark.parametrize("block_rows", [30, 5000])
@pytest.mark.parametrize("growing", [False, True])
def test_random_validation_of_every_kind(spark, block_rows, growing):
    prices, spec = walk(170, 43), SPEC.but(random_validation=True, block_rows=block_rows, sliding_window=not growing)
    px = frame(spark, {"a": prices})
    lines = random_loop(spark, prices, spec, least_squares)
    np.testing.assert_allclose(series_of(linear_forecasts(px, spec).toPandas(), "a"), lines, atol=1e-9)
    means = random_loop(spark, prices, spec, lambda x, y: lambda row: y.mean())
    np.testing.assert_allclose(series_of(forecaster.walk_forward(px, spec, MeanOfTargets()).toPandas(), "a"), means, atol=1e-9)
    boxes = random_loop(spark, prices, spec, by_loop(MedianBySign()))
    np.testing.assert_allclose(series_of(blackbox.walk_forward(px, spec, MedianBySign()).toPandas(), "a"), boxes, atol=1e-9)


@pytest.mark.parametrize("block_rows", [20, 5000])
def test_settings_equal_single_runs(spark, block_rows):
    prices = {"a": walk(200, 44), "b": walk(120, 45), "short": walk(30, 46)}
    prices["a"][50] = 0.0
    rows = [("w40", None, "lr", None, 40, 4, 3, 5), ("w21", None, "ridge", 2.0, 21, 3, 0, 1), ("up", "a", "nonneg", None, 65, 10, 7, 3), ("mean", "b", "mean", None, 32, 1, 1, 7), ("up", "b", "lr", None, 16, 2, 2, 1)]
    settings = spark.createDataFrame(rows, grid.SETTINGS)
    got = grid.grid_forecasts(frame(spark, prices), settings, SPEC.but(block_rows=block_rows)).toPandas()
    assert set(zip(got.series_id, got.model)) == {("a", "w40"), ("b", "w40"), ("a", "w21"), ("b", "w21"), ("short", "w21"), ("a", "up"), ("b", "mean"), ("b", "up")}

    def fit_of(model, penalty):
        def fit(x, y):
            c = x[:, 0] - x[:, 0].mean()
            slope = 0.0 if model == "mean" else (c @ y) / (c @ c + (penalty or 0.0))
            slope = max(slope, 0.0) if model == "nonneg" else slope
            return lambda row: y.mean() + slope * (row[0] - x[:, 0].mean())

        return fit

    for setting, only, model, penalty, w, p, v, f in rows:
        for name, series in prices.items():
            part = got[(got.model == setting) & (got.series_id == name)]
            if only not in (None, name) or not len(part):
                continue
            spec = SPEC.but(window_size=w, prediction_length=p, validation_size=v, frequency=f)
            want, true = loop_forecasts(series, spec, fit_of(model, penalty))
            np.testing.assert_allclose(series_of(part, name), want[w + 2 * p - 1 :], atol=1e-9)
            np.testing.assert_allclose(series_of(part, name, "true"), true[w + 2 * p - 1 :], atol=1e-12)


def test_settings_are_checked(spark):
    px = frame(spark, {"a": walk(60, 1)})
    for broken in [("x", None, "lr", None, 40, 4, 10, 5), ("x", None, "net", None, 40, 4, 3, 5), (None, None, "lr", None, 40, 4, 3, 5), ("x", "a", "lr", None, 40, 0, 3, 5)]:
        with pytest.raises(Exception, match="broken setting"):
            grid.grid_forecasts(px, spark.createDataFrame([broken], grid.SETTINGS), SPEC).collect()
    assert grid.grid_forecasts(px, spark.createDataFrame([], grid.SETTINGS), SPEC).collect() == []


def test_frames_of_any_length_are_merges():
    rng = np.random.default_rng(1)
    x, y, known = rng.normal(5, 1, 300), rng.normal(size=300), rng.random(300) > 0.1
    table = grid.FrameTable(x, y, known, 130)
    for length in (1, 2, 3, 64, 77, 130):
        first = np.arange(300 - length + 1)
        got = table.frames(first, length)
        for k in (0, 57, len(first) - 1):
            part = slice(k, k + length)
            a, b = x[part][known[part]], y[part][known[part]]
            assert got[k, 0] == len(a)
            if len(a):
                np.testing.assert_allclose(got[k, 1:], [a.mean(), b.mean(), ((a - a.mean()) ** 2).sum(), ((a - a.mean()) * b).sum()], atol=1e-9)


def test_frames_take_no_more_merges_than_parts(monkeypatch):
    rng, made = np.random.default_rng(2), []
    table = grid.FrameTable(rng.normal(size=200), rng.normal(size=200), rng.random(200) > 0.1, 130)
    merge = grid.merge
    monkeypatch.setattr(grid, "merge", lambda a, b: made.append(1) or merge(a, b))
    for length, merges in ((1, 0), (64, 0), (77, 3)):
        made.clear()
        assert table.frames(np.arange(100), length).shape == (100, 5)
        assert len(made) == merges

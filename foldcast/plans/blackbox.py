"""Forecasters that are any object with ``train`` and ``predict``.

``plans.forecaster`` takes models that follow from a mergeable summary; this
takes all others. A fold's rows reach the model as arrays, in groups of one block of
folds and the rows it looks back on.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.operators.fanout import MOST_BYTES, Run, apply_blocks, fan_out, pack
from foldcast.operators.folds import FoldSpec, fold_rows, random_draw, refits


class BlackBox(ABC):
    """``name`` is the model's name in the forecasts. Instances are sent to the workers."""

    name: str

    @abstractmethod
    def train(self, x: np.ndarray, y: np.ndarray, x_validation: np.ndarray, y_validation: np.ndarray):
        """The model fitted to a fold: inputs as rows, oldest first, and targets; missing values are 0."""

    @abstractmethod
    def predict(self, model, x: np.ndarray) -> np.ndarray:
        """One forecast for each row of complete inputs."""


def walk_forward(prices: DataFrame, spec: FoldSpec, *boxes: BlackBox, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Forecasts of every scheduled fold, one row per model.

    Rows are numbered, turned into inputs and targets, packed by block and copied
    to the blocks of folds that look back on them: at most two for sliding windows, all
    later ones for growing windows, which need all their rows in one place. A group beyond
    ``most_bytes`` raises. Every fold is trained from scratch, a fit that two blocks use in both.
    """
    w, p, f, v = spec.window_size, spec.prediction_length, spec.frequency, spec.validation_size
    # the rows themselves come with the packed blocks, so blocks carry no more than their lags
    plain = spec.but(sliding_window=False, validation_size=0, random_validation=False, frequency=1)
    rows = fold_rows(prices, plain).where("own")
    columns = [*spec.inputs, *spec.train_inputs, "y_l", "y", "dt"]
    if spec.random_validation:
        rows = rows.withColumn("held", F.when(refits(spec), random_draw(spec)))
        columns.append("held")
    back = w - 1 + spec.after_fit_rows if spec.sliding_window else None
    copies = fan_out(pack(rows, columns), plain.block_size, back)
    kind = rows.schema["dt"].dataType.simpleString()
    first_landed = w + 2 * p - 1

    def forecast(run: Run, _) -> pa.Table:
        own = np.arange(max(run.own, first_landed), run.end)
        made_at = own - p
        t = made_at - (p - 1)
        refit = t - t % f
        x = np.column_stack([run.floats(c) for c in spec.inputs])
        pairs = np.column_stack([run.floats(c) for c in spec.train_inputs])
        targets = run.floats("y_l")
        preds = np.full((len(boxes), len(own)), np.nan)
        for r in np.unique(refit[refit >= w]):
            e = r + p - 1
            at = np.arange((e - w + 1 if spec.sliding_window else p), e + 1) - run.first
            late = np.isin(at + run.first, run.data["held"][int(e - run.first)].as_py()) if spec.random_validation else at > e - v - run.first
            known = ~np.isnan(targets[at])
            train, check = at[~late & known], at[late & known]
            of_fit = np.flatnonzero(refit == r)
            inputs = x[made_at[of_fit] - run.first]
            whole = ~np.isnan(inputs).any(axis=1)
            for k, box in enumerate(boxes):
                model = box.train(pairs[train], targets[train], pairs[check], targets[check])
                if whole.any():
                    preds[k, of_fit[whole]] = box.predict(model, inputs[whole])
        each, at = len(own), own - run.first
        true = run.data["y"].take(pa.array(at))
        parts = [
            pa.table(
                {
                    "series_id": pa.array([run.series_id.as_py()] * each, pa.string()),
                    "dt": run.data["dt"].take(pa.array(at)),
                    "model": pa.array([box.name] * each, pa.string()),
                    "i": pa.array(own, pa.int64()),
                    "n": pa.array([run.n] * each, pa.int64()),
                    "pred": pa.array(preds[k], pa.float64(), from_pandas=True),
                    "true": true,
                }
            )
            for k, box in enumerate(boxes)
        ]
        return pa.concat_tables(parts)

    schema = f"series_id string, dt {kind}, model string, i bigint, n bigint, pred double, true double"
    return apply_blocks(copies, columns, forecast, schema, most_bytes=most_bytes)

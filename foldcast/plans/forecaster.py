"""A user's own forecaster, fitted from a training summary.

A forecaster says which summary of the training rows it needs, how a fit
follows from it, and how a fit scores a row; the folds, refits, horizon and
blocks are the library's.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.functions.summaries import Bundle, Moments
from foldcast.operators.blocks import BLOCK, spread
from foldcast.operators.folds import FoldSpec, carry_fit, fold_rows, land
from foldcast.plans.single_split import SplitSpec, fit_train, split_rows
from foldcast.plans.walk_forward import summarise, take_out_random


class Forecaster(ABC):
    """``name`` is the model's name in the forecasts."""

    name: str

    @abstractmethod
    def summary(self, inputs: list[str], target: str):
        """A summary from ``functions.summaries`` over input and target columns."""

    @abstractmethod
    def fit(self, train: Column, inputs: list[str], target: str) -> Column:
        """The fit, a struct, from the summary ``train``."""

    @abstractmethod
    def score(self, fit: Column, inputs: list[Column]) -> Column:
        """The forecast of one row, NULL where it cannot be made."""


@dataclass(frozen=True)
class OneInput(Forecaster):
    """Least squares on one input: ``penalty`` is added to its squares, ``positive`` keeps the slope from going below 0."""

    name: str = "lr"
    penalty: float = 0.0
    positive: bool = False

    def summary(self, inputs, target):
        (x,) = inputs
        return Moments((x, target), ((x, x), (x, target)))

    def fit(self, train, inputs, target):
        (x,) = inputs
        moments = self.summary(inputs, target)
        slope = F.coalesce(F.try_divide(moments.c(train, x, target), moments.c(train, x, x) + F.lit(self.penalty)), F.lit(0.0))
        if self.positive:
            slope = F.greatest(slope, F.lit(0.0))
        return F.struct(slope.alias("slope"), (train[f"m_{target}"] - slope * train[f"m_{x}"]).alias("level"))

    def score(self, fit, inputs):
        return fit["level"] + fit["slope"] * inputs[0]


def _fits(train: Column, forecasters: tuple[Forecaster, ...], inputs: list[str], target: str) -> Column:
    parts = [f.fit(train[f"f{k}"], inputs, target).alias(f"f{k}") for k, f in enumerate(forecasters)]
    return F.struct(*parts)


def _scored(rows: DataFrame, forecasters: tuple[Forecaster, ...], inputs: list[str]) -> DataFrame:
    columns = [F.col(x) for x in inputs]
    made = [f.score(F.col("fit")[f"f{k}"], columns).alias(f"f{k}") for k, f in enumerate(forecasters)]
    return rows.withColumn("forecast", F.struct(*made))


def _by_model(rows: DataFrame, forecasters: tuple[Forecaster, ...]) -> DataFrame:
    """One row a model from a struct of forecasts in ``pred``."""
    each = F.array(*[F.struct(F.lit(f.name).alias("model"), F.col("pred")[f"f{k}"].alias("pred")) for k, f in enumerate(forecasters)])
    out = rows.withColumn("_each", F.explode(each))
    return out.select("series_id", "dt", F.col("_each.model").alias("model"), "i", "n", F.col("_each.pred").alias("pred"), "true")


def walk_forward(prices: DataFrame, spec: FoldSpec, *forecasters: Forecaster) -> DataFrame:
    """Forecasts of every scheduled fold; all forecasters share one pass over the blocks."""
    bundle = Bundle(tuple((f"f{k}", f.summary(spec.train_inputs, "y_l")) for k, f in enumerate(forecasters)))
    rows = summarise(fold_rows(prices, spec), spec, bundle)
    if spec.random_validation:
        rows = take_out_random(rows, spec, bundle)
    rows = rows.withColumn("fit", _fits(F.col("train"), forecasters, spec.train_inputs, "y_l")).drop("train")
    rows = _scored(carry_fit(rows, spec), forecasters, spec.inputs)
    return _by_model(land(rows, spec, ""), forecasters)


def single_split(prices: DataFrame, split: SplitSpec, *forecasters: Forecaster) -> DataFrame:
    """Fit once on the training rows, forecast the test rows."""
    rows = split_rows(prices, split)
    bundle = Bundle(tuple((f"f{k}", f.summary(split.inputs, "y")) for k, f in enumerate(forecasters)))
    fits = fit_train(rows, bundle).select("series_id", "n", _fits(F.col("train"), forecasters, split.inputs, "y").alias("fit"))
    tested = rows.where("role = 'test'").join(spread(fits, split.block_rows).drop("n"), list(BLOCK))
    made = _scored(tested, forecasters, split.inputs).withColumns({"pred": F.col("forecast"), "true": F.col("y")})
    return _by_model(made, forecasters)

"""Fit once on the oldest rows of every series, forecast its newest rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.functions.regression import least_squares, linear_score
from foldcast.functions.summaries import Extremes, Moments
from foldcast.functions.values import fill_zero, growth
from foldcast.operators.blocks import BLOCK, BLOCK_ROWS, in_block, spread, to_blocks
from foldcast.operators.rows import number_rows
from foldcast.operators.splits import chronological_split


@dataclass(frozen=True)
class SplitSpec:
    lags: int = 3
    test_size: float = 0.1
    validation_size: float = 0.15
    block_rows: int = BLOCK_ROWS

    @property
    def inputs(self) -> list[str]:
        return [f"x{m}" for m in range(self.lags, 0, -1)]


def split_rows(prices: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Blocked rows with lagged returns ``x*``, the return ``y`` and a role.

    Here returns are taken before the lags, and missing values are 0.
    """
    blocks = to_blocks(number_rows(prices), halo=spec.lags + 1, block_rows=spec.block_rows)
    order = in_block()
    columns = {"y": fill_zero(growth(F.col("price"), F.lag("price", 1).over(order)))}
    for m in range(1, spec.lags + 1):
        columns[f"x{m}"] = fill_zero(growth(F.lag("price", m).over(order), F.lag("price", m + 1).over(order)))
    rows = blocks.withColumns(columns).where("own")
    return chronological_split(rows, spec.test_size, spec.validation_size).select(
        *BLOCK, "dt", "i", "n", "role", *spec.inputs, "y"
    )


def fit_train(rows: DataFrame, summary) -> DataFrame:
    train = F.col("role") == "train"
    return rows.groupBy("series_id").agg(summary.aggregate(where=train).alias("train"), F.max("n").alias("n"))


def linear_models(
    rows: DataFrame, spec: SplitSpec, fit_intercept: bool = True, positive: bool = False
) -> DataFrame:
    """One fitted model per series."""
    moments = Moments((*spec.inputs, "y"))
    fits = fit_train(rows, moments)
    fits = least_squares(fits, moments, "train", spec.inputs, "y", fit_intercept, positive)
    return fits.select("series_id", "n", "intercept", "coef", F.col("train.n").cast("bigint").alias("n_train"))


def linear_split(
    prices: DataFrame,
    spec: SplitSpec = SplitSpec(),
    fit_intercept: bool = True,
    positive: bool = False,
    model: str = "lr",
) -> DataFrame:
    rows = split_rows(prices, spec)
    fits = linear_models(rows, spec, fit_intercept, positive)
    return score_linear(rows.where("role = 'test'"), fits, spec, model)


def score_linear(rows: DataFrame, fits: DataFrame, spec: SplitSpec, model: str) -> DataFrame:
    """Score blocked rows with one stored or fitted model per series (needs its ``n``)."""
    per_block = spread(fits.select("series_id", "n", "intercept", "coef"), spec.block_rows).drop("n")
    scored = rows.join(per_block, list(BLOCK))
    return scored.select(
        "series_id",
        "dt",
        F.lit(model).alias("model"),
        "i",
        "n",
        linear_score("coef", "intercept", spec.inputs).alias("pred"),
        F.col("y").alias("true"),
    )


def tube_split(
    prices: DataFrame, spec: SplitSpec = SplitSpec(), epsilon: float = 0.1, model: str = "svr"
) -> DataFrame:
    """Support vector regression where the training targets fit inside the tube."""
    rows = split_rows(prices, spec)
    fits = fit_train(rows, Extremes("y"))
    low, high = F.col("train.low"), F.col("train.high")
    inside = high - low <= 2.0 * epsilon
    fits = fits.select("series_id", "n", inside.alias("in_tube"), F.when(inside, (low + high) / 2.0).alias("pred"))
    per_block = spread(fits, spec.block_rows).drop("n")
    return rows.where("role = 'test'").join(per_block, list(BLOCK)).select(
        "series_id", "dt", F.lit(model).alias("model"), "i", "n", "in_tube", "pred", F.col("y").alias("true")
    )

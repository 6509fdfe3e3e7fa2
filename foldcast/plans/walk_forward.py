"""Walk-forward forecasts that are frame expressions: linear and in-tube support vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.functions.regression import least_squares, linear_score
from foldcast.functions.summaries import Extremes, Moments
from foldcast.operators import frames
from foldcast.operators.asof import attach_newest
from foldcast.operators.blocks import BLOCK
from foldcast.operators.folds import (
    LINEAR,
    SUPPORT_VECTOR,
    FoldSpec,
    carry_fit,
    complete_from,
    fold_rows,
    land,
    random_draw,
    refits,
)


def summarise(rows: DataFrame, spec: FoldSpec, summary, name: str = "train") -> DataFrame:
    """Training summary of the fold whose as-of row is each row."""
    if spec.sliding_window:
        return frames.sliding(rows, summary, spec.window_size - 1, spec.withheld, name)
    valid, seen = complete_from(spec)
    return frames.growing(rows, summary, spec.withheld, name, valid, seen)


def take_out_random(rows: DataFrame, spec: FoldSpec, summary, name: str = "train") -> DataFrame:
    """Withhold V random pairs of every refitted fold.

    Only the V drawn rows are looked up; the rest of the fold is the frame
    summary without them. Drawn rows of a growing window may lie in any earlier block, so they are looked
    up where they are own rows, by ``(series_id, block, i)``.
    """
    drawn = rows.where(refits(spec) & (F.col("t") >= spec.window_size)).select(
        *BLOCK, F.col("i").alias("at"), F.explode(random_draw(spec)).alias("i")
    )
    home = F.floor(F.col("i") / spec.block_size)
    picked = drawn.withColumnsRenamed({"block": "at_block"}).withColumn("block", home)
    values = rows.where("own").select(*BLOCK, "i", *summary.columns)
    held = (
        picked.join(values, [*BLOCK, "i"])
        .groupBy("series_id", F.col("at_block").alias("block"), F.col("at").alias("i"))
        .agg(summary.aggregate().alias("_held"))
    )
    joined = rows.join(held, [*BLOCK, "i"], "left")
    rest = F.when(F.col("_held").isNotNull(), summary.without(F.col(name), F.col("_held")))
    return joined.withColumn(name, F.coalesce(rest, F.col(name))).drop("_held")


def linear_forecasts(
    prices: DataFrame,
    spec: FoldSpec = LINEAR,
    fit_intercept: bool = True,
    positive: bool = False,
    model: str = "lr",
) -> DataFrame:
    """Least squares refitted on every scheduled fold, P rows ahead."""
    return land(linear_fits(prices, spec, fit_intercept, positive), spec, model)


def linear_fits(
    prices: DataFrame, spec: FoldSpec = LINEAR, fit_intercept: bool = True, positive: bool = False
) -> DataFrame:
    """Blocked rows with the fit in force and the forecast made on each row."""
    x, y = spec.train_inputs, "y_l"
    if len(x) == 1:
        pairs: tuple = ((x[0], x[0]), (x[0], y))
    else:
        pairs = tuple((a, b) for k, a in enumerate(x) for b in x[k:]) + tuple((a, y) for a in x) + ((y, y),)
    moments = Moments((*x, y), pairs)
    rows = summarise(fold_rows(prices, spec), spec, moments)
    if spec.random_validation:
        rows = take_out_random(rows, spec, moments)
    rows = least_squares(rows, moments, "train", x, y, fit_intercept, positive)
    fit = F.struct("intercept", "coef", F.col("train.n").alias("n_train"), F.col("t").alias("refit_t"), F.col("dt").alias("fit_dt"))
    rows = carry_fit(rows.withColumn("fit", fit).drop("train", "intercept", "coef"), spec)
    rows = rows.withColumns({"intercept": F.col("fit.intercept"), "coef": F.col("fit.coef")})
    return rows.withColumn("forecast", linear_score("coef", "intercept", spec.inputs))


def refit_table(prices: DataFrame, spec: FoldSpec = LINEAR, **how) -> DataFrame:
    """One row per series and scheduled refit, for the model table."""
    rows = linear_fits(prices, spec, **how).where(F.col("own") & refits(spec))
    return rows.select("series_id", F.col("fit.*"))


def forecasts_from(
    prices: DataFrame, fits: DataFrame, spec: FoldSpec = LINEAR, model: str = "lr", newest: bool = False
) -> DataFrame:
    """Forecasts of stored fits ``(series_id, refit_t, fit_dt, intercept, coef)`` instead of fitted ones.

    A row takes the fit of its scheduled refit; a refit that is not stored gives NULL. With
    ``newest`` a row takes the newest fit stored at or before its own date, so that a run with gaps,
    or one that ended earlier, serves later data; positions need not agree then.
    """
    if newest:
        stored = fits.select("series_id", F.col("fit_dt").alias("dt"), F.struct(F.col("refit_t"), "intercept", "coef").alias("fit"))
        rows = fold_rows(prices, spec, lambda numbered: attach_newest(numbered, stored, "fit"))
        rows = rows.withColumns({"intercept": F.col("fit.intercept"), "coef": F.col("fit.coef")})
        if spec.frequency > 1:
            rows = rows.withColumn("refit_t", F.col("t") - F.pmod(F.col("t"), F.lit(spec.frequency)))
    else:
        rows = fold_rows(prices, spec).withColumn("refit_t", F.col("t") - F.pmod(F.col("t"), F.lit(spec.frequency)))
        stored = fits.select("series_id", F.col("refit_t").cast("bigint"), "intercept", "coef")
        rows = rows.join(stored, ["series_id", "refit_t"], "left")
    return land(rows.withColumn("forecast", linear_score("coef", "intercept", spec.inputs)), spec, model)


def tube_forecasts(
    prices: DataFrame, spec: FoldSpec = SUPPORT_VECTOR, epsilon: float = 0.1, model: str = "svr"
) -> DataFrame:
    """Support vector regression of folds that fit inside the tube.

    When the targets of a fold span at most 2*epsilon, the flat function at
    their mid-range has no loss and no norm, whatever the kernel. Other folds
    have no closed form: ``in_tube`` is false and ``pred`` NULL.
    """
    rows = summarise(fold_rows(prices, spec), spec, Extremes("y_l"))
    low, high = F.col("train.low"), F.col("train.high")
    fit = F.struct(((low + high) / 2.0).alias("level"), (high - low <= 2.0 * epsilon).alias("in_tube"))
    rows = carry_fit(rows.withColumn("fit", fit).drop("train"), spec)
    inside = F.col("fit.in_tube")
    forecast = F.struct(inside.alias("in_tube"), F.when(inside, F.col("fit.level")).alias("pred"))
    landed = land(rows.withColumn("forecast", forecast), spec, model)
    return landed.select(
        "series_id", "dt", "model", "i", "n", F.col("pred.in_tube").alias("in_tube"), F.col("pred.pred").alias("pred"), "true"
    )

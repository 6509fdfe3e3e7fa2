"""Every registered query: ``(spark, folder) -> DataFrame`` over whole tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.functions.summaries import Moments
from foldcast.functions.values import r6
from foldcast.operators import checks, folds, metrics, shaping, splits
from foldcast.operators.folds import AUTOREGRESSIVE, LINEAR, SUPPORT_VECTOR
from foldcast.operators.rows import number_rows
from foldcast.plans import autoregressive, blackbox, forecaster, grid, moving_average, single_split, walk_forward
from foldcast.session import shared_dir
from foldcast.sources import models as model_table
from foldcast.sources import prices as source
from foldcast.streaming import bars as stream_of_bars
from foldcast.streaming import scoring

# The given tables cover 1995-2001; the caps lie inside that range.
DATES = {"start_date": "1995-03-01", "end_date": "2001-06-30"}
LR = LINEAR.but(**DATES)
SVR = SUPPORT_VECTOR.but(**DATES)
FLAGS = ["A", "N", "R"]
TUBE = 4.0  # the test series move far more than the default tube of 0.1 allows


def flag_px(spark: SparkSession, folder: str) -> DataFrame:
    return source.lineitem_prices(spark, folder, "l_returnflag")


def supp_px(spark: SparkSession, folder: str) -> DataFrame:
    return source.lineitem_prices(spark, folder, "l_suppkey")


def order_px(spark: SparkSession, folder: str) -> DataFrame:
    return source.order_prices(spark, folder)


def event_px(spark: SparkSession, folder: str) -> DataFrame:
    return source.event_prices(spark, folder)


def _rounded(df: DataFrame, *exact: str) -> DataFrame:
    """Round every DOUBLE column but the ones named, for comparison."""
    kinds = dict(df.dtypes)
    return df.select(
        *[r6(F.col(c)).alias(c) if kinds[c] == "double" and c not in exact else F.col(c) for c in df.columns]
    )


def _forecasts(df: DataFrame) -> DataFrame:
    return _rounded(df.select("series_id", "dt", "pred", "true"))


# --- sources and shaping ---------------------------------------------------

def price_bars(spark, folder):
    return flag_px(spark, folder)


def order_bars(spark, folder):
    return order_px(spark, folder)


def event_grid(spark, folder):
    return event_px(spark, folder)


def wide_to_long(spark, folder):
    wide = source.to_wide(flag_px(spark, folder), FLAGS)
    return source.to_long(wide, FLAGS).where(F.col("price").isNotNull())


def instrument_pick(spark, folder):
    wide = source.to_wide(flag_px(spark, folder), FLAGS)
    return source.pick(wide, "N").na.drop(subset=["price"])


def ffill_grid(spark, folder):
    return shaping.forward_fill(event_px(spark, folder))


def leading_null_drop(spark, folder):
    """First kept row, kept rows and dropped leading rows per series."""
    numbered = number_rows(event_px(spark, folder))
    kept = numbered.groupBy("series_id").agg(F.min("dt").alias("first_dt"), F.count(F.lit(1)).alias("n_kept"))
    return kept.join(
        event_px(spark, folder).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_grid")), "series_id"
    ).select("series_id", "first_dt", "n_kept", (F.col("n_grid") - F.col("n_kept")).alias("n_dropped"))


def fill_zero(spark, folder):
    return shaping.fill_missing(event_px(spark, folder), ["price"])


def inf_guard(spark, folder):
    """Infinite ratio of discount to tax becomes 0."""
    items = source.read_table(spark, folder, "lineitem")
    ratio = F.when(F.col("l_tax") == 0.0, F.lit(float("inf"))).otherwise(
        F.try_divide(F.col("l_discount"), F.col("l_tax"))
    )
    table = items.select("l_orderkey", "l_linenumber", ratio.alias("ratio"))
    return shaping.replace_infinite(table, ["ratio"])


def date_cap(spark, folder):
    px = flag_px(spark, folder)
    return shaping.cap_dates(px, F.lit(LR.start_date).cast("date"), F.lit(LR.end_date).cast("date"))


def returns_1(spark, folder):
    return _rounded(shaping.returns(flag_px(spark, folder)).select("series_id", "dt", "ret"))


def returns_k(spark, folder):
    out = shaping.returns(order_px(spark, folder), periods=5)
    return _rounded(out.select("series_id", "dt", "ret"))


def returns_filled(spark, folder):
    """Hourly returns as an input column, over filled gaps."""
    out = shaping.returns(event_px(spark, folder), as_input=True)
    return _rounded(out.select("series_id", "dt", "ret"))


def supervised_3_1(spark, folder):
    return shaping.supervised(flag_px(spark, folder), ["price"], n_in=3, fill=True).drop("n")


def supervised_2_3(spark, folder):
    return shaping.supervised(supp_px(spark, folder), ["price"], n_in=2, n_out=3, fill=True).drop("n")


def supervised_multivar(spark, folder):
    """Two variables of one series: unit price and units shipped."""
    items = source.read_table(spark, folder, "lineitem")
    units = items.groupBy(
        F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("dt")
    ).agg(F.sum("l_quantity").alias("units"))
    both = shaping.align(flag_px(spark, folder), units)
    return shaping.supervised(both, ["price", "units"], n_in=2, n_out=2).drop("n")


def horizon_pairs(spark, folder):
    return shaping.horizon_pairs(flag_px(spark, folder), "price", 10)


def key_check(spark, folder):
    """Repeated keys of the raw lines, before they are aggregated to one price a day."""
    items = source.read_table(spark, folder, "lineitem")
    keys = items.select(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("dt"))
    return checks.repeated_keys(keys)


def index_check(spark, folder):
    """Dates on which only one of two series tables has a price."""
    left = flag_px(spark, folder).where("series_id = 'A'").withColumn("series_id", F.lit("x"))
    right = flag_px(spark, folder).where("series_id = 'N'").withColumn("series_id", F.lit("x"))
    out = checks.key_mismatches(left, right)
    return out.select(
        "dt", F.coalesce("in_left", F.lit(0)).alias("in_left"), F.coalesce("in_right", F.lit(0)).alias("in_right")
    )


def index_check_all(spark, folder):
    """Dates that not all suppliers have."""
    return checks.uneven_dates(supp_px(spark, folder))


def length_check(spark, folder):
    return checks.length_report(supp_px(spark, folder), LR)


# --- splits and folds ------------------------------------------------------

def split_train_val_test(spark, folder):
    numbered = number_rows(supp_px(spark, folder))
    return splits.chronological_split(numbered).select("series_id", "dt", "i", "role")


def fold_schedule(spark, folder):
    return folds.fold_schedule(flag_px(spark, folder), LR.but(frequency=7))


def fold_schedule_growing(spark, folder):
    return folds.fold_schedule(supp_px(spark, folder), LR.but(sliding_window=False))


MEMBERS = LR.but(frequency=42, validation_size=21)


def _members(spark, folder) -> DataFrame:
    return folds.fold_members(flag_px(spark, folder), MEMBERS)


def wf_val_rows(spark, folder):
    out = _members(spark, folder).where("role = 'validation'")
    return _rounded(out.select("series_id", "t", "i", F.col("x1").alias("x"), "target"))


def fold_train_anti(spark, folder):
    out = _members(spark, folder).where("role = 'train'")
    return _rounded(out.select("series_id", "t", "i", F.col("x1").alias("x")))


def fold_targets_semi(spark, folder):
    out = _members(spark, folder).where("role = 'train'")
    return _rounded(out.select("series_id", "t", "i", "target"))


def fold_score_rows(spark, folder):
    out = _members(spark, folder).where("role = 'score'")
    return _rounded(out.select("series_id", "t", "i", F.col("x1").alias("x")))


# --- linear regression -----------------------------------------------------

ONE_LAG = single_split.SplitSpec(lags=1)
TWO_LAGS = single_split.SplitSpec(lags=2)


def lr_single_split(spark, folder):
    return _forecasts(single_split.linear_split(supp_px(spark, folder), ONE_LAG))


def lr_multi_feature(spark, folder):
    return _forecasts(single_split.linear_split(flag_px(spark, folder)))


def lr_no_intercept(spark, folder):
    return _forecasts(single_split.linear_split(flag_px(spark, folder), ONE_LAG, fit_intercept=False))


def lr_nonneg(spark, folder):
    return _forecasts(single_split.linear_split(supp_px(spark, folder), ONE_LAG, positive=True))


FIVE_LAGS = single_split.SplitSpec(lags=5)


def lr_nonneg_wide(spark, folder):
    return _forecasts(single_split.linear_split(supp_px(spark, folder), FIVE_LAGS, positive=True))


def wf_lr_sliding(spark, folder):
    return _forecasts(walk_forward.linear_forecasts(flag_px(spark, folder), LR))


def wf_lr_suppliers(spark, folder):
    return _forecasts(walk_forward.linear_forecasts(supp_px(spark, folder), LR))


def wf_lr_growing(spark, folder):
    return _forecasts(walk_forward.linear_forecasts(supp_px(spark, folder), LR.but(sliding_window=False)))


def wf_lr_refit7(spark, folder):
    return _forecasts(walk_forward.linear_forecasts(flag_px(spark, folder), LR.but(frequency=7)))


def wf_lr_two_features(spark, folder):
    spec = LR.but(lags=2, frequency=7, validation_size=21)
    return _forecasts(walk_forward.linear_forecasts(flag_px(spark, folder), spec))


def wf_lr_long_returns(spark, folder):
    """Five-row input returns, two-row target returns."""
    spec = LR.but(input_pct_change=5, output_pct_change=2)
    return _forecasts(walk_forward.linear_forecasts(order_px(spark, folder), spec))


def wf_lr_blocked(spark, folder):
    """Same answer as ``wf_lr_sliding`` with series cut into small blocks."""
    return _forecasts(walk_forward.linear_forecasts(flag_px(spark, folder), LR.but(block_rows=300)))


RANDOM = LR.but(frequency=7, validation_size=10, random_validation=True)


def wf_random_validation(spark, folder):
    return _forecasts(walk_forward.linear_forecasts(flag_px(spark, folder), RANDOM))


RANDOM_GROWING = RANDOM.but(sliding_window=False, block_rows=500)


def wf_random_growing(spark, folder):
    """Validation rows drawn from the whole past, over several blocks."""
    return _forecasts(walk_forward.linear_forecasts(flag_px(spark, folder), RANDOM_GROWING))


# --- support vector regression ---------------------------------------------

def svr_tube_single(spark, folder):
    out = single_split.tube_split(supp_px(spark, folder), epsilon=TUBE)
    return _tube(out)


def wf_svr_tube(spark, folder):
    return _tube(walk_forward.tube_forecasts(flag_px(spark, folder), SVR, epsilon=TUBE))


def wf_svr_tube_growing(spark, folder):
    spec = SVR.but(sliding_window=False, frequency=7, block_rows=400)
    return _tube(walk_forward.tube_forecasts(flag_px(spark, folder), spec, epsilon=TUBE))


def wf_svr_log(spark, folder):
    """The default tube on the logarithms of prices, which move little."""
    logs = supp_px(spark, folder).withColumn("price", F.ln("price"))
    return _tube(walk_forward.tube_forecasts(logs, SVR))


def wf_svr_flat(spark, folder):
    """With a tube wider than any target, every fold has its mid-range."""
    return _forecasts(walk_forward.tube_forecasts(flag_px(spark, folder), SVR.but(frequency=7), epsilon=1e6))


def _tube(df: DataFrame) -> DataFrame:
    return _rounded(df.select("series_id", "dt", F.col("in_tube").cast("bigint").alias("in_tube"), "pred", "true"))


# --- a user's own forecasters -----------------------------------------------

@dataclass(frozen=True)
class MeanOfTargets(forecaster.Forecaster):
    """The mean of the training targets, whatever the inputs."""

    name: str = "mean"

    def summary(self, inputs, target):
        return Moments((target,), ())

    def fit(self, train, inputs, target):
        return F.struct(train[f"m_{target}"].alias("level"))

    def score(self, fit, inputs):
        return fit["level"]


@dataclass(frozen=True)
class Ridge(forecaster.Forecaster):
    """Least squares on one input with a penalty on the slope."""

    name: str = "ridge"
    penalty: float = 5.0

    def summary(self, inputs, target):
        return Moments((*inputs, target), ((inputs[0], inputs[0]), (inputs[0], target)))

    def fit(self, train, inputs, target):
        (x,) = inputs
        moments = self.summary(inputs, target)
        slope = moments.c(train, x, target) / (moments.c(train, x, x) + F.lit(self.penalty))
        return F.struct(slope.alias("slope"), (train[f"m_{target}"] - slope * train[f"m_{x}"]).alias("level"))

    def score(self, fit, inputs):
        return fit["level"] + fit["slope"] * inputs[0]


def wf_custom_mean(spark, folder):
    return _forecasts(forecaster.walk_forward(flag_px(spark, folder), LR.but(frequency=7, sliding_window=False), MeanOfTargets()))


def wf_custom_ridge(spark, folder):
    return _forecasts(forecaster.walk_forward(supp_px(spark, folder), LR, Ridge()))


def custom_split(spark, folder):
    return _forecasts(forecaster.single_split(supp_px(spark, folder), ONE_LAG, Ridge()))


@dataclass(frozen=True)
class MedianBySign(blackbox.BlackBox):
    """The median target of the training rows whose input had the sign of the row's own input."""

    name: str = "median"

    def train(self, x, y, x_validation, y_validation):
        rising = x[:, 0] > 0
        return [np.median(y[side]) if side.any() else np.median(y) for side in (~rising, rising)]

    def predict(self, model, x):
        return np.where(x[:, 0] > 0, model[1], model[0])


BLACKBOX = LR.but(frequency=7)
BLACKBOX_GROWING = LR.but(frequency=42, validation_size=2, sliding_window=False, block_rows=500)


def wf_custom_blackbox(spark, folder):
    """A model that no summary gives, trained by its own code on every fold."""
    return _forecasts(blackbox.walk_forward(flag_px(spark, folder), BLACKBOX, MedianBySign()))


def wf_custom_blackbox_growing(spark, folder):
    return _forecasts(blackbox.walk_forward(flag_px(spark, folder), BLACKBOX_GROWING, MedianBySign()))


# --- evaluation ------------------------------------------------------------

def _flag_forecasts(spark, folder) -> DataFrame:
    return walk_forward.linear_forecasts(flag_px(spark, folder), LR)


def wf_error(spark, folder):
    out = metrics.with_errors(_flag_forecasts(spark, folder))
    return _rounded(out.select("series_id", "dt", "error"))


def wf_sq_error(spark, folder):
    out = metrics.with_errors(_flag_forecasts(spark, folder))
    return _rounded(out.select("series_id", "dt", "sq_error"))


def wf_metrics(spark, folder):
    return _rounded(metrics.scores(walk_forward.linear_forecasts(supp_px(spark, folder), LR)))


def cum_log_return(spark, folder):
    out = metrics.cumulative_log_return(_flag_forecasts(spark, folder), ["pred", "true"])
    return _rounded(out.select("series_id", "dt", "cum_pred", "cum_true"))


def cum_log_return_single(spark, folder):
    out = metrics.cumulative_log_return(single_split.linear_split(flag_px(spark, folder)), ["pred", "true"])
    return _rounded(out.select("series_id", "dt", "cum_pred", "cum_true"))


def cum_log_return_models(spark, folder):
    """Two models in one table, each with its own product."""
    px = flag_px(spark, folder)
    both = walk_forward.linear_forecasts(px, LR).unionByName(
        walk_forward.tube_forecasts(px, SVR, epsilon=TUBE).drop("in_tube")
    )
    out = metrics.cumulative_log_return(both, ["pred"])
    return _rounded(out.select("series_id", "model", "dt", "cum_pred"))


def reattach_dates(spark, folder):
    """Forecasts saved without dates get them back from the price calendar."""
    saved = _flag_forecasts(spark, folder).select("series_id", "i", "pred", "true")
    calendar = number_rows(flag_px(spark, folder), start=LR.start_date, end=LR.end_date)
    out = metrics.reattach_dates(saved, calendar)
    return _rounded(out.select("series_id", "dt", "error"))


#: No date caps: the newest rows, which the single splits forecast, take part.
GRID = LR.but(start_date=None, end_date=None)
#: Models of the grid, (name, penalty, positive); each runs in both modes.
GRID_MODELS = [("lr", 0.0, False), ("nonneg", 0.0, True), ("ridge", 5.0, False)]


def _grid(spark, folder) -> DataFrame:
    """Models x modes over all series of one table, one pass a mode."""
    px = supp_px(spark, folder)

    def models(mode: str):
        return [forecaster.OneInput(f"{n}_{mode}", p, positive) for n, p, positive in GRID_MODELS] + [MeanOfTargets(f"mean_{mode}")]

    walked = forecaster.walk_forward(px, GRID, *models("wf"))
    return walked.unionByName(forecaster.single_split(px, ONE_LAG, *models("split")))


def grid_leaderboard(spark, folder):
    """Ranked on the dates that all eight models forecast."""
    scored = metrics.scores(metrics.on_common_dates(_grid(spark, folder), 8)).select("series_id", "model", "n_obs", "rmse", "mae")
    return _rounded(metrics.leaderboard(scored).withColumn("place", F.col("place").cast("bigint")))


#: Settings of all series: windows x refit schedules.
GRID_SETTINGS = [
    (f"{m}_{w}_{f}", None, m, 5.0 if m == "ridge" else 0.0, w, 10, v, f)
    for w, v, m in ((63, 2, "lr"), (126, 5, "ridge"), (252, 1, "nonneg"))
    for f in (1, 7)
]


def _settings(spark, folder) -> DataFrame:
    """The settings of all series, and one more for every tenth supplier."""
    keys = source.read_table(spark, folder, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").cast("string").alias("series_id"))
    own = keys.selectExpr("'own' AS setting", "series_id", "'mean' AS model", "0.0D AS penalty", "100 AS window_size", "5 AS prediction_length", "3 AS validation_size", "5 AS frequency")
    return spark.createDataFrame(GRID_SETTINGS, grid.SETTINGS).unionByName(own)


def grid_settings(spark, folder):
    """All settings of a table over all series in one pass, scored and ranked."""
    made = grid.grid_forecasts(supp_px(spark, folder), _settings(spark, folder), GRID)
    scored = metrics.scores(made).select("series_id", "model", "n_obs", "rmse", "mae")
    return _rounded(metrics.leaderboard(scored).withColumn("place", F.col("place").cast("bigint")))


# --- model table -----------------------------------------------------------

def model_roundtrip(spark, folder):
    """Fit, save, load the saved fits, and score the test rows with them."""
    spec = TWO_LAGS
    rows = single_split.split_rows(flag_px(spark, folder), spec)
    run, path = uuid.uuid4().hex, f"{shared_dir(spark)}/models"
    fitted = single_split.linear_models(rows, spec)
    named = fitted.withColumn("refit_t", F.col("n"))
    model_table.save_models(model_table.as_model_table(named, "lr", run, {"lags": "2"}), path)
    loaded = model_table.latest_fits(model_table.load_models(spark, path, "lr", run))
    loaded = loaded.withColumn("n", F.col("refit_t"))
    return _forecasts(single_split.score_linear(rows.where("role = 'test'"), loaded, spec, "lr"))


def wf_model_reload(spark, folder):
    """Save every refit of a walk-forward run, then forecast from the saved fits alone."""
    spec = LR.but(frequency=7)
    run, path = uuid.uuid4().hex, f"{shared_dir(spark)}/models"
    fits = walk_forward.refit_table(flag_px(spark, folder), spec)
    model_table.save_models(model_table.as_model_table(fits, "lr", run), path)
    loaded = model_table.load_models(spark, path, "lr", run)
    return _forecasts(walk_forward.forecasts_from(flag_px(spark, folder), loaded, spec))


def wf_model_asof(spark, folder):
    """Every third refit is missing from the table; rows take the newest fit that is there."""
    spec = LR.but(frequency=7)
    run, path = uuid.uuid4().hex, f"{shared_dir(spark)}/models"
    fits = walk_forward.refit_table(flag_px(spark, folder), spec).where("refit_t div 7 % 3 <> 1")
    model_table.save_models(model_table.as_model_table(fits, "lr", run), path)
    loaded = model_table.load_models(spark, path, "lr", run)
    return _forecasts(walk_forward.forecasts_from(flag_px(spark, folder), loaded, spec, newest=True))


# --- streams ---------------------------------------------------------------

def stream_bars(spark, folder):
    """Hourly bars of the events as a stream of files that ends."""
    width, delay, at = "1 hour", "2 hours", f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    table = source.read_table(spark, folder, "events")

    def event(df: DataFrame) -> DataFrame:
        return df.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))

    stream_of_bars.closing_row(event(table), width, delay).write.parquet(f"{at}/closing")
    # as a pattern, because a stream takes no single file
    arriving = event(stream_of_bars.file_stream(spark, f"{folder}/event[s].parquet", table.schema))
    closing = stream_of_bars.file_stream(spark, f"{at}/closing", stream_of_bars.EVENT)
    stream_of_bars.drain(stream_of_bars.bars(arriving.unionByName(closing), width, delay), f"{at}/bars", f"{at}/checkpoint")
    return spark.read.schema("series_id string, dt timestamp, price double").parquet(f"{at}/bars").withColumn("dt", F.col("dt").cast("timestamp_ntz"))


def stream_score(spark, folder):
    """Test rows arrive as files and are scored by the fits of the model table."""
    at, run = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}", uuid.uuid4().hex
    rows = single_split.split_rows(flag_px(spark, folder), TWO_LAGS)
    fitted = single_split.linear_models(rows, TWO_LAGS).withColumn("refit_t", F.col("n"))
    model_table.save_models(model_table.as_model_table(fitted, "lr", run), f"{at}/models")
    new = rows.where("role = 'test'").select("series_id", "dt", *TWO_LAGS.inputs, "y")
    new.write.parquet(f"{at}/rows")
    arriving = stream_of_bars.file_stream(spark, f"{at}/rows", new.schema)
    scored = scoring.score_stream(arriving, model_table.load_models(spark, f"{at}/models", "lr", run), TWO_LAGS.inputs, "lr")
    stream_of_bars.drain(scored, f"{at}/scored", f"{at}/checkpoint")
    return _forecasts(spark.read.schema(scored.schema).parquet(f"{at}/scored"))


def csv_roundtrip(spark, folder):
    """Prices written as a wide CSV file and read back."""
    path = f"{shared_dir(spark)}/prices-{uuid.uuid4().hex}"
    wide = source.to_wide(flag_px(spark, folder), FLAGS)
    # columns are found by name, so their order in the file does not matter
    wide.select(F.date_format("dt", "yyyy-MM-dd").alias("dt"), *reversed(FLAGS)).write.option("header", True).csv(path)
    prices = source.to_long(source.read_wide_csv(spark, path, FLAGS), FLAGS).where(F.col("price").isNotNull())
    return prices


# --- autoregression --------------------------------------------------------

AR = AUTOREGRESSIVE.but(**DATES)
AR5 = autoregressive.ArSpec()
KPSS_LAGS = 4


def kpss_level(spark, folder):
    numbered = shaping.returns(supp_px(spark, folder))
    return _rounded(autoregressive.kpss_by_series(numbered, "ret", KPSS_LAGS))


def arx_order_aic(spark, folder):
    out = autoregressive.order_search(flag_px(spark, folder), AR5)
    return _rounded(out.select("series_id", "p", "n_train", "rss", "aic", "chosen"))


def arx_fit(spark, folder):
    """Coefficients of the fifth-order fit of every series."""
    out = autoregressive.order_search(supp_px(spark, folder), AR5).where("p = 5")
    columns = [F.col("beta")[0].alias("beta"), *[F.col("phi")[k].alias(f"phi{k + 1}") for k in range(5)]]
    return _rounded(out.select("series_id", "n_train", "intercept", *columns))


def arx_split(spark, folder):
    """Order chosen and fitted once; every test row forecast from the end of training."""
    return _forecasts(autoregressive.autoregressive_split(flag_px(spark, folder), AR5))


def wf_arx_forecast(spark, folder):
    return _forecasts(autoregressive.autoregressive_forecasts(flag_px(spark, folder), AR, AR5))


def wf_arx_sliding(spark, folder):
    spec = AR.but(sliding_window=True, block_rows=500)
    return _forecasts(autoregressive.autoregressive_forecasts(flag_px(spark, folder), spec, AR5))


def wf_arx_same_steps(spark, folder):
    """The reported alignment: P steps from the end of training, repeated until the next refit."""
    ar = autoregressive.ArSpec(compat=True)
    return _forecasts(autoregressive.autoregressive_forecasts(flag_px(spark, folder), AR, ar))


def wf_arx_difference(spark, folder):
    """Difference chosen per fold by the level test."""
    ar = autoregressive.ArSpec(difference=None)
    return _forecasts(autoregressive.autoregressive_forecasts(flag_px(spark, folder), AR, ar))


AR_SLIDING = AR.but(sliding_window=True, block_rows=600)


def wf_arx_difference_sliding(spark, folder):
    """Difference chosen per fold of a sliding window, whatever the lags of the level test."""
    ar = autoregressive.ArSpec(difference=None)
    return _forecasts(autoregressive.autoregressive_forecasts(flag_px(spark, folder), AR_SLIDING, ar))


def arma_hr(spark, folder):
    """Orders with moving-average terms, least AIC per fold."""
    out = moving_average.moving_average_forecasts(flag_px(spark, folder), AR)
    return _forecasts(out)


def arma_hr_sliding(spark, folder):
    return _forecasts(moving_average.moving_average_forecasts(flag_px(spark, folder), AR.but(sliding_window=True)))


def arma_split(spark, folder):
    """Orders with moving-average terms chosen and fitted once; every test row forecast from the end of training."""
    return _forecasts(moving_average.moving_average_split(flag_px(spark, folder)))

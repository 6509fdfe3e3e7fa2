"""Single splits, the model table, own forecasters and price files."""

import numpy as np
import pytest
from helpers import frame, loop_forecasts, series_of, walk
from pyspark.sql import functions as F

from foldcast.catalog.queries import MeanOfTargets, Ridge
from foldcast.operators import metrics
from foldcast.operators.folds import LINEAR
from foldcast.plans import forecaster
from foldcast.plans.single_split import SplitSpec, linear_models, linear_split, score_linear, split_rows
from foldcast.plans.walk_forward import forecasts_from, linear_forecasts, refit_table, tube_forecasts
from foldcast.session import shared_dir
from foldcast.sources import models as table
from foldcast.sources import prices as source

SPEC = LINEAR.but(start_date=None, end_date=None, window_size=40, prediction_length=4, validation_size=3, frequency=5)


# --- own forecasters, stored fits, short series ----------------------------------

@pytest.mark.parametrize("block_rows", [30, 5000])
@pytest.mark.parametrize("growing", [False, True])
def test_own_forecasters_equal_the_loop(spark, block_rows, growing):
    prices, spec = walk(140, 31), SPEC.but(block_rows=block_rows, sliding_window=not growing)

    def ridge(x, y):
        c = x[:, 0] - x[:, 0].mean()
        slope = (c @ y) / (c @ c + 5.0)
        return lambda row: y.mean() + slope * (row[0] - x[:, 0].mean())

    for own, fit in ((MeanOfTargets(), lambda x, y: lambda row: y.mean()), (Ridge(), ridge)):
        got = forecaster.walk_forward(frame(spark, {"a": prices}), spec, own).toPandas()
        want, _ = loop_forecasts(prices, spec, fit)
        np.testing.assert_allclose(series_of(got, "a"), want[spec.window_size + 2 * 4 - 1 :], atol=1e-9)


@pytest.mark.parametrize("block_rows", [30, 5000])
def test_stored_fits_forecast_like_fresh_ones(spark, block_rows):
    px, spec = frame(spark, {"a": walk(140, 32), "b": walk(90, 33)}), SPEC.but(block_rows=block_rows)
    again = forecasts_from(px, refit_table(px, spec), spec).orderBy("series_id", "i").collect()
    fresh = linear_forecasts(px, spec).orderBy("series_id", "i").collect()
    assert [r.pred for r in again] == pytest.approx([r.pred for r in fresh])


@pytest.mark.parametrize("make", [linear_forecasts, tube_forecasts, refit_table])
def test_series_shorter_than_the_window(spark, make):
    px = frame(spark, {"long": walk(90, 34), "short": walk(8, 35)})
    with pytest.raises(Exception, match="series short has 8 rows"):
        make(px, SPEC).collect()
    got = make(px, SPEC.but(short_series="skip"))
    assert {r.series_id for r in got.collect()} == {"long"}


def test_models_keep_their_own_products(spark):
    rows = [("a", k, m, p) for k, (x, y) in enumerate([(0.1, -0.5), (0.2, 1.0), (None, 0.5)]) for m, p in (("one", x), ("two", y))]
    df = spark.createDataFrame(rows, "series_id string, k int, model string, r double").selectExpr("*", "date_add(date'2020-01-01', k) AS dt").drop("k")
    got = {m: [r.cum_r for r in metrics.cumulative_log_return(df, ["r"]).where(F.col("model") == m).orderBy("dt").collect()] for m in ("one", "two")}
    assert got["one"] == pytest.approx(np.log([1.1, 1.32, 1.32])) and got["two"] == pytest.approx(np.log([0.5, 1.0, 1.5]))


def test_only_common_dates_are_ranked(spark):
    df = spark.createDataFrame(
        [("a", 1, "x", 1.0, 1.0), ("a", 1, "y", 2.0, 1.0), ("a", 2, "x", None, 1.0), ("a", 2, "y", 1.0, 1.0)],
        "series_id string, dt int, model string, pred double, true double",
    )
    assert {r.n_obs for r in metrics.scores(metrics.on_common_dates(df, 2)).collect()} == {1}


# --- linear single split, model table, files ------------------------------------

@pytest.mark.parametrize("block_rows", [9, 5000])
def test_single_split_regression(spark, block_rows):
    prices = walk(120, 37)
    split = SplitSpec(block_rows=block_rows)
    got = series_of(linear_split(frame(spark, {"a": prices}), split).toPandas(), "a")
    r = np.concatenate([[0.0], prices[1:] / prices[:-1] - 1])
    x = np.column_stack([np.concatenate([np.zeros(m), r[:-m]]) for m in (3, 2, 1)])
    a = np.column_stack([np.ones(len(r)), x])
    b = np.linalg.lstsq(a[:91], r[:91], rcond=None)[0]
    np.testing.assert_allclose(got, a[108:] @ b, atol=1e-10)


def test_model_table(spark):
    split = SplitSpec(lags=2)
    rows = split_rows(frame(spark, {"a": walk(120, 38), "b": walk(100, 39)}), split)
    fits = linear_models(rows, split).withColumn("refit_t", F.col("n"))
    path = f"{shared_dir(spark)}/test-models-{np.random.default_rng().integers(1 << 60)}"
    older = table.as_model_table(fits.withColumn("refit_t", F.lit(1)).withColumn("intercept", F.lit(9.0)), "lr", "one")
    table.save_models(older.unionByName(table.as_model_table(fits, "lr", "one", {"k": "v"})), path)
    table.save_models(table.as_model_table(fits.limit(1), "lr", "two"), path)
    assert table.load_models(spark, path, "lr", "one").count() == 4
    latest = table.latest_fits(table.load_models(spark, path, "lr", "one")).withColumn("n", F.col("refit_t"))
    test = rows.where("role = 'test'")
    again = score_linear(test, latest, split, "lr").orderBy("series_id", "i").collect()
    direct = score_linear(test, linear_models(rows, split), split, "lr").orderBy("series_id", "i").collect()
    assert [r.pred for r in again] == [r.pred for r in direct]


def test_csv_prices(spark, tmp_path):
    (tmp_path / "etfs.csv").write_text("Date,GLD,SPY\n2020-01-02,10.5,NaN\n2020-01-03,,3.5\n2020-01-06,11,4\n")
    wide = source.read_wide_csv(spark, str(tmp_path / "etfs.csv"), ["GLD", "SPY"])
    assert [r.price for r in source.pick(wide, "GLD").orderBy("dt").collect()] == [10.5, None, 11.0]
    long = source.to_long(wide, ["GLD", "SPY"]).where("price is not null").orderBy("series_id", "dt").collect()
    assert [(r.series_id, str(r.dt), r.price) for r in long] == [
        ("GLD", "2020-01-02", 10.5), ("GLD", "2020-01-06", 11.0), ("SPY", "2020-01-03", 3.5), ("SPY", "2020-01-06", 4.0),
    ]


class Cluster:
    """Stands in for a session; only what the lookup asks for."""

    def __init__(self, named, master):
        self.conf, self.sparkContext = self, self
        self.named, self.master = named, master

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.named

    def getCheckpointDir(self):
        return None


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(Cluster("hdfs:/shared", "yarn")) == "hdfs:/shared"
    with pytest.raises(ValueError, match="every executor"):
        shared_dir(Cluster(None, "yarn"))
    assert shared_dir(spark)

"""Tiny frames with answers worked out by hand."""

import math

import pytest
from helpers import frame
from pyspark.sql import functions as F

from foldcast.functions.values import guard_infinity, nan_to_null
from foldcast.operators import checks, metrics, shaping
from foldcast.operators.folds import LINEAR, FoldSpec, fold_schedule
from foldcast.operators.rows import number_rows
from foldcast.operators.splits import chronological_split


def column(df, name):
    return [r[name] for r in df.orderBy("series_id", "dt").collect()]


def test_fill_drops_only_leading_gaps(spark):
    px = frame(spark, {"a": [None, 10, None, 12], "b": [None, None, 5, None]})
    assert column(shaping.forward_fill(px), "price") == [10, 10, 12, 5, 5]


@pytest.mark.parametrize("width", [1, 2, 3, 1000])
def test_fill_and_positions_do_not_depend_on_buckets(spark, width):
    px = frame(spark, {"a": [None, None, 3, None, None, None, 7, 8, None], "b": [1, None, None, None, 2]})
    out = number_rows(px, bucket_width=width).orderBy("series_id", "i").collect()
    assert [r.price for r in out] == [3, 3, 3, 3, 7, 8, 8, 1, 1, 1, 1, 2]
    assert [r.i for r in out] == [*range(7), *range(5)]
    assert {(r.series_id, r.n) for r in out} == {("a", 7), ("b", 5)}


def test_date_cap_restarts_positions_and_keeps_earlier_rows(spark):
    px = frame(spark, {"a": [1, 2, 3, 4, 5]})
    out = number_rows(px, start="2010-01-03", end="2010-01-04", bucket_width=2).orderBy("dt").collect()
    assert [(r.i, r.n, r.n_all) for r in out] == [(-2, 2, 5), (-1, 2, 5), (0, 2, 5), (1, 2, 5)]


def test_repeated_key_raises(spark):
    px = frame(spark, {"a": [1, 2]}).union(frame(spark, {"a": [3]}))
    with pytest.raises(Exception, match="repeated time in series a"):
        number_rows(px).collect()
    assert checks.repeated_keys(px).count() == 1
    with pytest.raises(ValueError, match="repeated key"):
        checks.require(px, LINEAR)


def test_returns(spark):
    px = frame(spark, {"a": [100, None, 110, 0, 50]})
    got = column(shaping.returns(px), "ret")
    assert got[:2] == [None, 0] and got[2] == pytest.approx(0.1) and got[3:] == [-1, None]
    assert column(shaping.returns(px, as_input=True), "ret")[4] == 0
    assert column(shaping.returns(frame(spark, {"a": [10, 20, 30]}), periods=2), "ret") == [None, None, 2]


@pytest.mark.parametrize("block_rows", [1, 2, 100])
def test_supervised_frame(spark, block_rows):
    px = frame(spark, {"a": [1, 2, 3, 4]})
    out = shaping.supervised(px, ["price"], n_in=2, n_out=2, block_rows=block_rows).orderBy("i").collect()
    assert [tuple(r)[4:] for r in out] == [(None, None, 1, 2), (None, 1, 2, 3), (1, 2, 3, 4), (2, 3, 4, None)]


@pytest.mark.parametrize("validation,expected", [(0.15, (76, 14, 11)), (0.01, (89, 1, 11))])
def test_split_sizes(spark, validation, expected):
    rows = chronological_split(number_rows(frame(spark, {"a": range(1, 102)})), 0.1, validation)
    counts = dict(rows.groupBy("role").count().collect())
    assert (counts["train"], counts["validation"], counts["test"]) == expected


def test_fold_schedule(spark):
    px = frame(spark, {"a": range(1, 301)})
    spec = LINEAR.but(start_date=None, end_date=None, frequency=7)
    rows = fold_schedule(px, spec).orderBy("t").collect()
    assert (rows[0].t, rows[-1].t, len(rows)) == (252, 290, 39)
    assert (rows[0].train_from, rows[0].train_to) == (0, 250)
    assert (rows[1].train_from, rows[1].train_to) == (1, 251)
    assert [r.t for r in rows if r.refit] == [252, 259, 266, 273, 280, 287]


def test_settings_are_checked():
    FoldSpec(validation_size=62)
    with pytest.raises(ValueError, match="takes a quarter"):
        FoldSpec(validation_size=63)
    with pytest.raises(ValueError, match="before the first forecast"):
        FoldSpec(window_size=250, frequency=7, strict=True)


def test_missing_and_infinite_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert [r[0] for r in df.select(nan_to_null(F.col("x"))).collect()] == [None, math.inf, 2.0]
    assert [r[0] for r in df.select(guard_infinity(F.col("x"))).collect()][1:] == [0.0, 2.0]


def test_scores(spark):
    df = spark.createDataFrame(
        [("a", "m", 1.1, 1.0), ("a", "m", 0.7, 1.0), ("b", "m", 1.0, 1.0), ("b", "m", 2.0, 2.0), ("b", "m", 4.0, 3.0)],
        "series_id string, model string, pred double, true double",
    )
    got = {r.series_id: r for r in metrics.scores(df).collect()}
    assert got["a"].mse == pytest.approx(0.05) and got["a"].rmse == pytest.approx(0.223607, abs=1e-6)
    assert got["a"].mae == pytest.approx(0.2) and got["b"].r2 == pytest.approx(0.5)


@pytest.mark.parametrize("block_rows", [1, 2, 100])
def test_cumulative_log_return(spark, block_rows):
    px = frame(spark, {"a": [None, 0.1, -0.5], "b": [-2, -2, -1]}).withColumnRenamed("price", "r")
    out = metrics.cumulative_log_return(px, ["r"], block_rows=block_rows)
    got = column(out, "cum_r")
    assert got[:3] == pytest.approx([0, 0.095310, -0.597837], abs=1e-6)
    assert math.isnan(got[3]) and got[4] == pytest.approx(0.0) and got[5] == -math.inf

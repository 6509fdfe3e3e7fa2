"""As-of attachment, non-negative fits of any width, price files by name, and streams."""

import datetime as dt
import itertools

import numpy as np
import pytest
from helpers import frame, walk
from pyspark.sql import functions as F

from foldcast.functions.regression import non_negative
from foldcast.operators.asof import attach_newest
from foldcast.operators.folds import LINEAR
from foldcast.session import shared_dir
from foldcast.sources import models as table
from foldcast.sources import prices as source
from foldcast.streaming import bars, scoring
from foldcast.plans.walk_forward import forecasts_from, linear_forecasts, refit_table

SPEC = LINEAR.but(start_date=None, end_date=None, window_size=40, prediction_length=4, validation_size=3, frequency=5)


@pytest.mark.parametrize("width", [3, 4096])
def test_newest_event_as_of_each_row(spark, width):
    rng = np.random.default_rng(3)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=int(k))
    rows = [(s, day(k), float(k)) for s in "ab" for k in rng.choice(300, 80, replace=False)]
    events = [(s, day(k), int(v)) for s in "abc" for k, v in zip(rng.choice(300, 12), rng.integers(0, 99, 12))] + [("a", day(5), None)]
    got = attach_newest(spark.createDataFrame(rows, "series_id string, dt date, price double"), spark.createDataFrame(events, "series_id string, dt date, fit long"), "fit", width)
    for r in got.collect():
        before = [(d, v) for s, d, v in events if s == r.series_id and d <= r.dt and v is not None]
        assert r.fit == (max(before)[1] if before else None)
    assert got.count() == len(rows) and got.columns == ["series_id", "dt", "price", "fit"]


@pytest.mark.parametrize("block_rows", [30, 5000])
def test_newest_stored_fits(spark, block_rows):
    prices, spec = walk(170, 51), SPEC.but(block_rows=block_rows)
    px = frame(spark, {"a": prices})
    fits = refit_table(px, spec)
    everything = [r.pred for r in forecasts_from(px, fits, spec, newest=True).orderBy("i").collect()]
    assert everything == pytest.approx([r.pred for r in linear_forecasts(px, spec).orderBy("i").collect()])
    # a run that ended earlier goes on serving: its last fit makes all later forecasts
    early = [r.pred for r in forecasts_from(px, fits.where("refit_t <= 80"), spec, newest=True).orderBy("i").collect()]
    last = fits.where("refit_t = 80").first()
    x = np.r_[np.nan, np.nan, prices[1:-1] / prices[:-2] - 1]
    first = spec.window_size + 2 * 4 - 1
    for k, (a, b) in enumerate(zip(early, everything)):
        made_at = first + k - 4
        assert a == pytest.approx(b if made_at - 3 < 85 else last.intercept + last.coef[0] * x[made_at])


def nnls_by_hand(g, r):
    best = (0.0, np.zeros(len(r)))
    for size in range(1, len(r) + 1):
        for on in map(list, itertools.combinations(range(len(r)), size)):
            b = np.linalg.lstsq(g[np.ix_(on, on)], r[on], rcond=None)[0]
            if (b >= 0).all() and b @ r[on] > best[0] + 1e-12:
                full = np.zeros(len(r))
                full[on] = b
                best = (b @ r[on], full)
    return best[1]


def test_non_negative_fits_of_any_width(spark):
    rng = np.random.default_rng(8)
    for m in (1, 2, 4, 6, 8):
        want, cells = [], []
        for _ in range(25):
            x = rng.normal(size=(40, m)) + rng.normal(size=(40, 1)) * rng.integers(0, 3)
            y = x @ rng.normal(size=m) + rng.normal(size=40)
            x, y = x - x.mean(0), y - y.mean()
            z = np.column_stack([x, y])
            want.append(nnls_by_hand(x.T @ x, x.T @ y))
            cells.append(((z.T @ z).ravel().tolist(), len(cells)))
        got = spark.createDataFrame(cells, "a array<double>, k int").select("k", non_negative(F.col("a"), m).alias("b")).orderBy("k").collect()
        np.testing.assert_allclose([r.b for r in got], want, atol=1e-8)


def test_non_negative_fits_of_dependent_and_empty_inputs(spark):
    x = np.array([[1.0, 2.0, 0.0, -1.0, 3.0]] * 9) * np.arange(9)[:, None]
    y = np.arange(9.0)
    z = np.column_stack([x - x.mean(0), y - y.mean()])
    cells = [((z.T @ z).ravel().tolist(),), ([0.0] * 36,)]
    a, b = (np.array(r.b) for r in spark.createDataFrame(cells, "a array<double>").select(non_negative(F.col("a"), 5).alias("b")).collect())
    assert (a >= 0).all() and x @ a - (x @ a).mean() == pytest.approx(y - y.mean()) and not b.any()


def test_stream_counts_rows_within_the_watermark(spark):
    import uuid

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], bars.EVENT).write.parquet(f"{at}/in")
    made = bars.bars(bars.file_stream(spark, f"{at}/in", bars.EVENT), "1 hour", "2 hours")

    def arrive(*rows):
        df = spark.createDataFrame([(s, dt.datetime(2020, 1, 1, h, m), v) for s, h, m, v in rows], bars.EVENT)
        df.coalesce(1).write.mode("append").parquet(f"{at}/in")
        bars.drain(made, f"{at}/out", f"{at}/checkpoint")
        got = spark.read.schema("series_id string, dt timestamp, price double").parquet(f"{at}/out")
        return {(r.series_id, r.dt.hour): r.price for r in got.collect()}

    assert arrive(("a", 1, 0, 1.0), ("b", 1, 30, 5.0), ("a", 2, 10, 4.0)) == {}
    # within the watermark: counts; the bar of hour 1 is closed once the newest row is past 4:00
    assert arrive(("a", 1, 59, 2.0), ("a", 4, 5, 7.0)) == {("a", 1): 1.5, ("b", 1): 5.0}
    # beyond it: hour 1 is not given again, hour 2 still counts; a null value and a row without series count nowhere
    closed = arrive(("a", 1, 10, 100.0), ("a", 2, 50, 6.0), ("a", 2, 55, None), (None, 9, 0, 3.0))
    assert closed == {("a", 1): 1.5, ("b", 1): 5.0, ("a", 2): 5.0, ("a", 4): 7.0}


def test_stream_scores_by_the_newest_fit(spark):
    import uuid

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    fits = [("a", 1, 1.0, [2.0]), ("a", 5, 10.0, [3.0]), ("b", 2, 0.0, [1.0])]
    stored = spark.createDataFrame(fits, "series_id string, refit_t long, intercept double, coef array<double>")
    table.save_models(table.as_model_table(stored, "lr", "run"), f"{at}/models")
    kind = "series_id string, dt date, x1 double, y double"
    rows = [("a", dt.date(2020, 1, 1), 2.0, 0.5), ("b", dt.date(2020, 1, 1), 4.0, None), ("c", dt.date(2020, 1, 1), 1.0, 1.0), ("a", dt.date(2020, 1, 2), None, 1.0)]
    spark.createDataFrame(rows, kind).write.parquet(f"{at}/in")
    made = scoring.score_stream(bars.file_stream(spark, f"{at}/in", kind), table.load_models(spark, f"{at}/models", "lr", "run"), ["x1"], "lr")
    for _ in range(2):  # draining again adds nothing
        bars.drain(made, f"{at}/out", f"{at}/checkpoint")
        got = {(r.series_id, r.dt.day): r.pred for r in spark.read.schema(made.schema).parquet(f"{at}/out").collect()}
        assert got == {("a", 1): 16.0, ("b", 1): 4.0, ("c", 1): None, ("a", 2): None}


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,SPY,note,GLD\n2020-01-01,1.5,x,10\n2020-01-02,,y,NaN\n")
    got = source.read_wide_csv(spark, str(tmp_path / "a.csv"), ["GLD", "SPY"])
    assert got.columns == ["dt", "GLD", "SPY"]
    long = {(r.series_id, r.dt.day): r.price for r in source.to_long(got, ["GLD", "SPY"]).collect()}
    assert long == {("GLD", 1): 10.0, ("SPY", 1): 1.5, ("GLD", 2): None, ("SPY", 2): None}
    with pytest.raises(ValueError, match="OIL"):
        source.read_wide_csv(spark, str(tmp_path / "a.csv"), ["OIL"])
    (tmp_path / "bad.csv").write_text("Date,SPY\n2020-01-01,abc\n")
    with pytest.raises(Exception, match="MALFORMED|abc"):
        source.read_wide_csv(spark, str(tmp_path / "bad.csv"), ["SPY"]).collect()
    (tmp_path / "none.csv").write_text("2020-01-01,3\n")
    assert source.read_wide_csv(spark, str(tmp_path / "none.csv"), ["SPY"], header=False).first().SPY == 3.0

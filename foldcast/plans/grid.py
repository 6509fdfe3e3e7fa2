"""Many settings in one pass: windows, horizons, schedules and models from a table.

Each block of rows, with the rows before it that its widest window reaches, is
read once for all settings. Pairs of one horizon get a table of summaries
of 1, 2, 4, ... rows, so that a frame of any length is the merge of as many of
them as its length has binary ones, and nothing is subtracted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.operators.fanout import MOST_BYTES, Run, apply_blocks, fan_out, pack
from foldcast.operators.folds import FoldSpec, fold_rows

#: ``series_id`` NULL stands for all series. Models: lr, ridge (with ``penalty``), nonneg, mean.
SETTINGS = (
    "setting string, series_id string, model string, penalty double, window_size int, prediction_length int, validation_size int, frequency int"
)
MODELS = ("lr", "ridge", "nonneg", "mean")
FIELDS = [f.split()[0] for f in SETTINGS.split(", ")]

N, MX, MY, XX, XY = range(5)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, means and centred products of two disjoint groups of rows (Chan, Golub and LeVeque 1979), one pair a column."""
    n = a[N] + b[N]
    share = np.divide(b[N], n, out=np.zeros(len(n)), where=n > 0)
    d = b[MX : MY + 1] - a[MX : MY + 1]
    between = a[N] * share
    merged = np.empty((5, len(n)))
    merged[N] = n
    merged[MX : MY + 1] = a[MX : MY + 1] + d * share
    merged[XX:] = a[XX:] + b[XX:] + d[0] * d * between
    return merged


class FrameTable:
    """Summaries of runs of 2^k pairs, by their first position."""

    def __init__(self, x: np.ndarray, y: np.ndarray, known: np.ndarray, longest: int) -> None:
        zero = np.zeros(len(x))
        single = np.array([known.astype(float), np.where(known, x, 0.0), np.where(known, y, 0.0), zero, zero])
        self.levels = [single]
        while 2 ** len(self.levels) <= min(longest, len(x)):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(merge(last[:, :-half], last[:, half:]))

    def frames(self, first: np.ndarray, length: int) -> np.ndarray:
        """Summaries of the runs of ``length`` pairs from each position, one a row."""
        total, at = None, first
        for k in range(len(self.levels) - 1, -1, -1):
            if length >> k & 1:
                part = self.levels[k][:, at]
                total = part if total is None else merge(total, part)
                at = at + (1 << k)
        return total.T


def _lines(s: np.ndarray, model: str, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and slopes of each summary; the slope of a constant input is 0."""
    s = s.T
    own = np.where(s[XX] > s[N] * s[MX] ** 2 * 1e-20, s[XX], 0.0)
    below = own + (penalty if model == "ridge" else 0.0)
    slope = np.divide(s[XY], below, out=np.zeros(len(below)), where=below > 0)
    if model == "nonneg":
        slope = np.maximum(slope, 0.0)
    if model == "mean":
        slope = np.zeros(len(below))
    return np.where(s[N] > 0, s[MY] - slope * s[MX], np.nan), slope


def _checked(settings: DataFrame) -> DataFrame:
    """Settings with defaults; broken ones raise where they are read."""
    given = settings.select(*[F.col(c) if c in settings.columns else F.lit(None).alias(c) for c in FIELDS])
    whole = {c: F.col(c).cast("bigint") for c in FIELDS[4:]}
    given = given.withColumns(whole | {"penalty": F.coalesce(F.col("penalty").cast("double"), F.lit(0.0)), "model": F.coalesce("model", F.lit("lr"))})
    w, p, v, f = (F.col(c) for c in FIELDS[4:])
    fine = F.col("setting").isNotNull() & F.col("model").isin(*MODELS) & (w >= 1) & (p >= 1) & (f >= 1) & (v >= 0) & (v < F.floor(w / 4.0)) & (F.col("penalty") >= 0)
    told = F.concat(F.lit("broken setting "), F.to_json(F.struct(*FIELDS)))
    return given.withColumn("window_size", F.when(F.coalesce(fine, F.lit(False)), w).otherwise(F.raise_error(told).cast("bigint")))


def grid_forecasts(prices: DataFrame, settings: DataFrame, spec: FoldSpec, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Walk-forward forecasts of sliding windows for every setting of every series; ``model`` is the setting's name.

    ``settings`` has the columns of ``SETTINGS``. Settings of all series are few and go to every
    block with its function; those of one series are joined to its blocks. ``spec`` gives what is
    common: dates, returns, blocks, infinite targets. A series that a window does not fit into has no
    forecasts of that setting.
    """
    checked = _checked(settings)
    # training inputs lie another horizon back
    widest = checked.agg(F.max(F.col("window_size") + F.col("frequency") + 2 * F.col("prediction_length"))).first()[0]
    common = [r.asDict() for r in checked.where("series_id IS NULL").distinct().collect()]
    plain = spec.but(sliding_window=False, validation_size=0, frequency=1, prediction_length=1, lags=1, window_size=4, random_validation=False, short_series="skip")
    rows = fold_rows(prices, plain).where("own")
    columns = ["x1", "y_l", "y", "dt"]
    packed = pack(rows, columns)
    own = checked.where("series_id IS NOT NULL").distinct().groupBy("series_id").agg(F.collect_list(F.struct(*[c for c in FIELDS if c != "series_id"])).alias("own"))
    copies = fan_out(packed.join(own, "series_id", "left"), plain.block_size, widest or 0)
    kind = rows.schema["dt"].dataType.simpleString()

    def forecast(run: Run, extra: dict) -> pa.Table:
        x, y = run.floats("x1"), run.floats("y_l")
        parts, tables = [], {}
        todo = [*common, *(extra["own"] or [])]
        longest = {}
        for s in todo:
            p = s["prediction_length"]
            longest[p] = max(longest.get(p, 0), s["window_size"] - s["validation_size"])
        for s in todo:
            w, p, v, f = (s[c] for c in FIELDS[4:])
            if p not in tables:
                at = np.arange(len(x)) - p
                inputs = np.where(at >= 0, np.nan_to_num(x[np.maximum(at, 0)]), 0.0)
                known = ~np.isnan(y) & (np.arange(len(x)) + run.first >= p)
                tables[p] = FrameTable(inputs, np.nan_to_num(y), known, longest[p])
            landed = np.arange(max(run.own, w + 2 * p - 1), run.end)
            if run.n <= w or not len(landed):
                continue
            t = landed - p - (p - 1)
            refit = t - t % f
            fits = np.arange(refit[0], refit[-1] + 1, f)  # positions rise by one
            of_row = (refit - refit[0]) // f
            usable = fits >= w
            first = np.where(usable, fits + p - w - run.first, 0)
            level, slope = _lines(tables[p].frames(first, w - v), s["model"], s["penalty"])
            level = np.where(usable, level, np.nan)
            preds = level[of_row] + slope[of_row] * x[landed - p - run.first]
            at, each = int(landed[0]) - run.first, len(landed)
            parts.append(
                pa.table(
                    {
                        "series_id": pa.repeat(pa.scalar(run.series_id.as_py(), pa.string()), each),
                        "dt": run.data["dt"].slice(at, each),
                        "model": pa.repeat(pa.scalar(s["setting"], pa.string()), each),
                        "i": pa.array(landed, pa.int64()),
                        "n": pa.repeat(pa.scalar(run.n, pa.int64()), each),
                        "pred": pa.array(preds, pa.float64(), from_pandas=True),
                        "true": run.data["y"].slice(at, each),
                    }
                )
            )
        return pa.concat_tables(parts).combine_chunks() if parts else pa.table({n: pa.array([], t) for n, t in _empty(run.data["dt"].type)})

    schema = f"series_id string, dt {kind}, model string, i bigint, n bigint, pred double, true double"
    return apply_blocks(copies, columns, forecast, schema, extra=["own"], most_bytes=most_bytes)


def _empty(kind: pa.DataType) -> list[tuple[str, pa.DataType]]:
    text, whole, real = pa.string(), pa.int64(), pa.float64()
    return [("series_id", text), ("dt", kind), ("model", text), ("i", whole), ("n", whole), ("pred", real), ("true", real)]

"""Walk-forward folds: settings, the rows of a series, schedules and members.

With W = window, P = horizon, V = validation rows, a fold t has the as-of row
e = t+P-1, trains on pairs (input of row j-P, target of row j) and forecasts
row e+P from the inputs of row e. Sliding folds use j in [e-W+1, e-V], growing
folds j in [P, e-V].
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldcast.functions.values import fill_zero, growth, input_return, left_zero
from foldcast.operators.blocks import BLOCK, BLOCK_ROWS, in_block, latest_first, to_blocks
from foldcast.operators.rows import number_rows


@dataclass(frozen=True)
class FoldSpec:
    """Settings of a walk-forward run; ``lags`` is the number of input columns."""

    start_date: str | None = "2000-01-03"
    end_date: str | None = "2020-10-13"
    input_pct_change: int = 1
    output_pct_change: int = 1
    window_size: int = 252
    frequency: int = 7
    prediction_length: int = 10
    validation_size: int = 10
    sliding_window: bool = True
    random_validation: bool = False
    lags: int = 1
    strict: bool = False
    infinite_target: str = "drop"
    seed: int = 1
    block_rows: int = BLOCK_ROWS
    extra_rows: int = 0  # further rows a model looks back from its training pairs
    short_series: str = "raise"  # or "skip": what to do with a series no longer than the window

    def __post_init__(self) -> None:
        if self.validation_size >= int(self.window_size / 4.0):
            raise ValueError(f"validation_size {self.validation_size} takes a quarter of window_size {self.window_size} or more")
        if min(self.prediction_length, self.frequency, self.lags, self.input_pct_change, self.output_pct_change) < 1:
            raise ValueError("lags, horizon, refit frequency and return periods must be at least 1")
        if self.validation_size < 0:
            raise ValueError("validation_size must not be negative")
        if self.short_series not in ("raise", "skip"):
            raise ValueError("short_series is 'raise' or 'skip'")
        if self.infinite_target not in ("drop", "zero"):
            raise ValueError("infinite_target is 'drop' or 'zero'")
        if self.strict and self.window_size % self.frequency:
            raise ValueError("no model is fitted before the first forecast: window_size % frequency != 0")

    def but(self, **changes) -> "FoldSpec":
        return replace(self, **changes)

    @property
    def withheld(self) -> int:
        """Newest pairs of a fold kept out of the frame (random ones are taken out later)."""
        return 0 if self.random_validation else self.validation_size

    @property
    def frame_length(self) -> int:
        return self.window_size - self.withheld

    @property
    def lag_rows(self) -> int:
        """Rows a training pair looks back."""
        own = max(self.lags + self.input_pct_change + self.prediction_length, self.output_pct_change)
        return own + self.extra_rows

    @property
    def after_fit_rows(self) -> int:
        """Rows between the oldest fit a row may use and the row its forecast lands on."""
        return self.frequency - 1 + self.prediction_length

    @property
    def halo(self) -> int:
        look_back = self.window_size - 1 if self.sliding_window else self.withheld
        return self.lag_rows + look_back + self.after_fit_rows

    @property
    def block_size(self) -> int:
        return max(self.block_rows, self.halo)

    @property
    def inputs(self) -> list[str]:
        """Oldest lag first, as the lag frame orders its columns."""
        return [f"x{m}" for m in range(self.lags, 0, -1)]

    @property
    def train_inputs(self) -> list[str]:
        return [f"{x}_l" for x in self.inputs]


LINEAR = FoldSpec(start_date="2004-11-08", end_date="2021-06-01", frequency=1, validation_size=1)
SUPPORT_VECTOR = LINEAR.but(validation_size=2)
AUTOREGRESSIVE = LINEAR.but(frequency=42, validation_size=2, sliding_window=False)


def _return_columns(spec: FoldSpec, over) -> dict[str, Column]:
    """Inputs and target of row i, and the inputs of row i-P filled for training."""
    k, p = spec.input_pct_change, spec.prediction_length
    price = F.col("price")

    def back(rows: int) -> Column:
        return price if rows == 0 else F.lag("price", rows).over(over)

    columns = {}
    for m in range(1, spec.lags + 1):
        # returns are taken after the date cap, so the first k capped rows have none
        columns[f"x{m}"] = F.when(F.col("i") >= k, input_return(back(m), back(m + k)))
        late = F.when(F.col("i") - p >= k, input_return(back(m + p), back(m + p + k)))
        columns[f"x{m}_l"] = F.coalesce(late, F.lit(0.0))
    q = spec.output_pct_change
    columns["y"] = F.when(F.col("i") >= q, growth(price, back(q)))
    columns["_y_inf"] = (F.col("i") >= q) & left_zero(price, back(q))
    return columns


def numbered_prices(prices: DataFrame, spec: FoldSpec) -> DataFrame:
    """Positions of capped rows; a series that the window does not fit into raises, or is left out."""
    rows = number_rows(prices.select("series_id", "dt", "price"), start=spec.start_date, end=spec.end_date)
    fits = F.col("n_all") > spec.window_size
    if spec.short_series == "skip":
        return rows.where(fits)
    told = F.concat(
        F.lit("series "), F.col("series_id").cast("string"), F.lit(" has "), F.col("n_all").cast("string"),
        F.lit(f" rows, no more than window_size {spec.window_size}"),
    )
    return rows.withColumn("n", F.when(fits, F.col("n")).otherwise(F.raise_error(told).cast("bigint")))


def fold_rows(prices: DataFrame, spec: FoldSpec, attach=None) -> DataFrame:
    """Blocked rows with inputs ``x*``, target ``y`` and training pairs ``x*_l, y_l``.

    ``attach`` may add columns to the numbered rows before they are cut into blocks. A pair is NULL as a whole before row P and where the target is infinite;
    other missing values inside a pair are 0. Inputs to be scored stay missing.
    """
    numbered = numbered_prices(prices, spec)
    blocks = to_blocks(
        attach(numbered) if attach else numbered,
        halo=spec.halo,
        block_rows=spec.block_size,
        segment=spec.frame_length,
    )
    rows = blocks.withColumns(_return_columns(spec, in_block()))
    usable = F.col("i") >= spec.prediction_length
    if spec.infinite_target == "drop":
        usable = usable & ~F.col("_y_inf")
    pairs = {"y_l": F.when(usable, fill_zero(F.col("y")))}
    pairs |= {name: F.when(usable, F.col(name)) for name in spec.train_inputs}
    if spec.infinite_target == "zero":
        pairs["y"] = F.when(F.col("_y_inf"), F.lit(0.0)).otherwise(F.col("y"))
    t = F.col("i") - (spec.prediction_length - 1)
    return rows.withColumns(pairs | {"t": t}).drop("_y_inf", "n_all")


def complete_from(spec: FoldSpec) -> tuple[Column, Column]:
    """First position with complete pairs in a block, and in the block after it."""
    start = F.col("block") * spec.block_size
    offset = spec.lag_rows - spec.halo
    here = F.when(F.col("block") == 0, F.lit(0).cast("bigint")).otherwise(start + offset)
    return here, start + spec.block_size + offset


def refits(spec: FoldSpec) -> Column:
    """True on rows where the model is fitted anew."""
    return (F.col("t") >= spec.window_size) & (F.pmod(F.col("t"), F.lit(spec.frequency)) == 0)


def carry_fit(rows: DataFrame, spec: FoldSpec, fit: str = "fit") -> DataFrame:
    """Between refits every row uses the latest fit; NULL before the first one."""
    kept = F.when(refits(spec), F.col(fit))
    if spec.frequency == 1:
        return rows.withColumn(fit, kept)
    rows = rows.withColumn("refit_t", F.col("t") - F.pmod(F.col("t"), F.lit(spec.frequency)))
    since = (
        Window.partitionBy(*BLOCK, "refit_t")
        .orderBy("i")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return rows.withColumn("_kept", kept).withColumn(fit, F.first("_kept", ignorenulls=True).over(since)).drop("_kept")


def land(rows: DataFrame, spec: FoldSpec, model: str) -> DataFrame:
    """Move the forecast made at row e to row e+P and pair it with the target there."""
    p = spec.prediction_length
    if spec.frequency > 1:  # same sort as carry_fit
        moved = F.lag("forecast", p).over(Window.partitionBy(*BLOCK).orderBy("refit_t", "i"))
    elif "_nseg" in rows.columns:  # same sort as the sliding frames, latest row first
        moved = F.lead("forecast", p).over(latest_first())
    else:
        moved = F.lag("forecast", p).over(in_block())
    landed = rows.withColumn("pred", moved)
    first = spec.window_size + 2 * p - 1
    return landed.where(F.col("own") & (F.col("i") >= first)).select(
        "series_id", "dt", F.lit(model).alias("model"), "i", "n", "pred", F.col("y").alias("true")
    )


def fold_schedule(prices: DataFrame, spec: FoldSpec) -> DataFrame:
    """One row per fold: as-of date, training bounds, and whether it refits."""
    numbered = numbered_prices(prices, spec)
    t = F.col("i") - (spec.prediction_length - 1)
    low = t - spec.window_size if spec.sliding_window else F.lit(0).cast("bigint")
    return numbered.where(t >= spec.window_size).select(
        "series_id",
        t.alias("t"),
        F.col("dt").alias("as_of"),
        low.alias("train_from"),
        (t - spec.validation_size - 1).alias("train_to"),
        (F.pmod(t, F.lit(spec.frequency)) == 0).cast("bigint").alias("refit"),
    )


def fold_members(prices: DataFrame, spec: FoldSpec) -> DataFrame:
    """Rows of every refitted sliding fold with their role.

    Each row computes the folds it belongs to from its own position, so there
    is no join; the result has (W+P)/frequency rows per input row. Inputs of
    training and validation rows are filled, those to be scored are not.
    ``target`` is the target P rows later, inside the fold.
    """
    if not spec.sliding_window or spec.random_validation:
        raise ValueError("members are listed for sliding folds with tail validation; use frames otherwise")
    w, p, f = spec.window_size, spec.prediction_length, spec.frequency
    numbered = numbered_prices(prices, spec)
    halo = spec.lags + spec.input_pct_change
    size = max(spec.block_rows, halo, p)
    blocks = to_blocks(numbered, halo=max(halo, spec.output_pct_change), block_rows=size, ahead=p)
    rows = blocks.withColumns(_return_columns(spec, in_block()))
    rows = rows.withColumn("target", F.lead("y", p).over(in_block())).where("own")
    # folds t, multiples of f, with t-W <= i <= t+P-1 and W <= t <= n-P
    low = F.greatest(F.col("i") - (p - 1), F.lit(w))
    high = F.least(F.col("i") + w, F.col("n") - p)
    first = F.ceil(low / f) * f
    rows = rows.where(first <= high).withColumn("t", F.explode(F.sequence(first, high, F.lit(f).cast("bigint"))))
    role = (
        F.when(F.col("i") >= F.col("t"), "score")
        .when(F.col("i") >= F.col("t") - spec.validation_size, "validation")
        .otherwise("train")
    )
    rows = rows.withColumn("role", role)
    known = F.col("role") != "score"
    inputs = [
        F.when(known, fill_zero(F.col(x))).otherwise(F.col(x)).alias(x) for x in spec.inputs
    ]
    return rows.select(
        "series_id", "t", "i", "dt", "role", *inputs, F.when(known, fill_zero(F.col("target"))).alias("target")
    )


def random_positions(low: Column, count: Column, draws: int, tag: list[Column]) -> Column:
    """``draws`` distinct positions in ``[low, low+count)``, every subset equally likely.

    Floyd's sampling (Bentley and Floyd 1987) over a hash of ``tag`` and the
    draw, so a fold draws the same rows on every run.
    """

    def draw(j: Column) -> Column:
        text = F.concat_ws(":", *[c.cast("string") for c in tag], j.cast("string"))
        return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), j + 1)

    def add(chosen: Column, j: Column) -> Column:
        r = draw(j)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, r), j).otherwise(r)))

    empty = F.array().cast("array<bigint>")
    picked = F.aggregate(F.sequence(count - draws, count - 1), empty, add)
    return F.transform(picked, lambda x: x + low)


def random_draw(spec: FoldSpec) -> Column:
    """Target positions of the V random validation pairs of the fold of each row."""
    p, w = spec.prediction_length, spec.window_size
    low = F.col("t") - w + p if spec.sliding_window else F.lit(p).cast("bigint")
    count = F.lit(w).cast("bigint") if spec.sliding_window else F.col("t")
    return random_positions(low, count, spec.validation_size, [F.col("series_id"), F.col("t"), F.lit(spec.seed)])

"""Autoregressions with outside inputs: order, difference, fit, multi-step forecast.

Each candidate is a least-squares regression of the target on its own lags and
the inputs, so every fold is fitted from one moment summary. Estimates differ
from maximum likelihood; the moving-average terms are in ``plans.moving_average``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldcast.functions.regression import swept
from foldcast.functions.summaries import Moments, Sums
from foldcast.functions.triangles import centred, means, products
from foldcast.operators import frames
from foldcast.operators.blocks import BLOCK, BLOCK_ROWS, in_block, running_totals, spread, to_blocks
from foldcast.operators.folds import AUTOREGRESSIVE, FoldSpec, fold_rows, land, refits
from foldcast.operators.sums import refit_sums, window_of
from foldcast.plans.affine import ahead_of_training
from foldcast.plans.single_split import SplitSpec, split_rows

# Critical values of the level test, Kwiatkowski et al. (1992), table 1. Fixed values.
KPSS_CRITICAL = {0.1: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}


@dataclass(frozen=True)
class ArSpec:
    """``difference=None`` chooses it per fold by the level test; up to ``max_difference``.

    ``kpss_lags=None`` takes the test's own rule; ``longest_lags`` is what the
    rule gives for the longest series, and is read from the data.
    """

    max_p: int = 5
    difference: int | None = 0
    max_difference: int = 2
    alpha: float = 0.05
    kpss_lags: int | None = None
    longest_lags: int | None = None
    compat: bool = False

    @property
    def differences(self) -> list[int]:
        return [self.difference] if self.difference is not None else list(range(self.max_difference + 1))


def kpss_lag_rule(n: Column) -> Column:
    """Short bandwidth: trunc(3 sqrt(n) / 13)."""
    return F.floor(F.sqrt(n) * 3.0 / 13.0)


def kpss_statistic(n: Column, squares: Column, gamma: list[Column], lags: Column | int) -> Column:
    """Sum of squared partial sums over n^2 times the Bartlett long-run variance."""
    bandwidth = F.lit(float(lags)) if isinstance(lags, int) else lags.cast("double")
    long_run = gamma[0]
    for s in range(1, len(gamma)):
        weight = F.when(F.lit(float(s)) <= bandwidth, 1.0 - F.lit(float(s)) / (bandwidth + 1.0))
        long_run = long_run + 2.0 * F.coalesce(weight, F.lit(0.0)) * gamma[s]
    return F.try_divide(squares, n * long_run)


def kpss_by_series(returns: DataFrame, column: str, lags: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Level-stationarity test of each series: statistic, and whether 5 % accepts it.

    ``returns`` is numbered (``i``, ``n``); missing values count as 0.
    """
    value = F.coalesce(F.col(column), F.lit(0.0))
    blocks = to_blocks(returns.select("series_id", "i", "n", value.alias("v")), halo=lags, block_rows=block_rows)
    size = max(block_rows, lags)
    centre = (
        blocks.where("own").groupBy("series_id").agg(F.avg("v").alias("centre"), F.max("n").alias("n"))
    )
    rows = blocks.join(spread(centre, size).drop("n", "series_n"), list(BLOCK))
    rows = rows.withColumn("e", F.col("v") - F.col("centre"))
    products = {f"g{s}": F.col("e") * (F.lag("e", s).over(in_block()) if s else F.col("e")) for s in range(lags + 1)}
    rows = rows.withColumns(products).where("own")
    rows = running_totals(rows, {"level": F.col("e")})
    total = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sum(F.col("level") * F.col("level")).alias("squares"),
        *[F.coalesce(F.sum(f"g{s}"), F.lit(0.0)).alias(f"g{s}") for s in range(lags + 1)],
    )
    statistic = kpss_statistic(
        F.col("n_obs").cast("double"), F.col("squares"), [F.col(f"g{s}") for s in range(lags + 1)], lags
    )
    out = total.select("series_id", "n_obs", statistic.alias("statistic"))
    return out.withColumn("stationary", (F.col("statistic") < KPSS_CRITICAL[0.05]).cast("bigint"))


# --- regression on own lags --------------------------------------------------

def _names(d: int, inputs: list[str], max_p: int) -> tuple[list[str], list[str], str]:
    return [f"d{d}_{u}" for u in inputs], [f"d{d}_v{a}" for a in range(1, max_p + 1)], f"d{d}_v"


def _differenced(column: str, d: int, order) -> Column:
    """d-th difference of a column over rows."""
    at = [F.col(column) if k == 0 else F.lag(column, k).over(order) for k in range(d + 1)]
    if d == 0:
        return at[0]
    if d == 1:
        return at[0] - at[1]
    return at[0] - 2.0 * at[1] + at[2]


def candidate_fits(summary: Column, moments: Moments, d: int, inputs: list[str], max_p: int, only: Column | None = None) -> Column:
    """Array over p = 0..max_p of struct(aic, p, d, n, rss, intercept, beta, phi)."""
    us, vs, v = _names(d, inputs, max_p)
    names = [*us, *vs, v]
    m, k = len(names), len(us)
    flat = F.array(*[moments.c(summary, a, b) for a in names for b in names])
    states = swept(flat, m, list(range(m - 1)))
    if only is not None:
        states = F.when(only, states)
    n = summary["n"]

    def candidate(state: Column, at: Column) -> Column:
        p = at - F.lit(k - 1)
        rss = F.get(state, F.lit(m * m - 1))
        coef = [
            F.when(F.lit(f - k) < p, F.get(state, F.lit(f * m + m - 1))).otherwise(F.lit(0.0))
            for f in range(m - 1)
        ]
        intercept = summary[f"m_{v}"]
        for f, name in enumerate(names[:-1]):
            intercept = intercept - coef[f] * summary[f"m_{name}"]
        fit = F.when(rss > 0, n * F.ln(rss / n)).otherwise(F.lit(float("-inf")))
        return F.struct(
            (fit + 2.0 * (p + F.lit(k + 1))).alias("aic"),
            p.cast("bigint").alias("p"),
            F.lit(d).alias("d"),
            n.alias("n"),
            rss.alias("rss"),
            intercept.alias("intercept"),
            F.array(*coef[:k]).alias("beta"),
            F.array(*coef[k:]).alias("phi"),
        )

    every = F.transform(states, candidate)
    return F.filter(F.slice(every, k, max_p + 1), lambda c: c["n"] > F.lit(0.0))


def order_search(prices: DataFrame, spec: ArSpec, split: SplitSpec = SplitSpec(lags=1)) -> DataFrame:
    """Every order p of every series, fitted on the training rows, with its AIC and rank."""
    # the lags of the target are the lagged returns themselves
    wide = split_rows(prices, SplitSpec(spec.max_p, split.test_size, split.validation_size, split.block_rows))
    d = 0
    us, vs, v = _names(d, split.inputs, spec.max_p)
    usable = (F.col("role") == "train") & (F.col("i") >= spec.max_p)
    columns = {u: F.col(x) for u, x in zip(us, split.inputs)}
    columns |= {name: F.col(f"x{a}") for a, name in enumerate(vs, 1)} | {v: F.col("y")}
    rows = wide.select("series_id", *[F.when(usable, c).alias(name) for name, c in columns.items()])
    moments = Moments((*us, *vs, v))
    fits = rows.groupBy("series_id").agg(moments.aggregate().alias("train"))
    every = candidate_fits(F.col("train"), moments, d, split.inputs, spec.max_p)
    best = F.array_min(F.transform("every", lambda c: F.struct(c["aic"], c["p"])))["p"]
    # fits are made once: a column of its own for both uses, and an outer explode, for which Spark adds no filter on their number
    out = fits.select("series_id", every.alias("every")).withColumn("best", best)
    out = out.select("series_id", F.explode_outer("every").alias("c"), "best").where("c IS NOT NULL")
    return out.select(
        "series_id",
        "c.p",
        F.col("c.n").cast("bigint").alias("n_train"),
        "c.rss",
        "c.aic",
        "c.intercept",
        "c.beta",
        "c.phi",
        (F.col("c.p") == F.col("best")).cast("bigint").alias("chosen"),
    )


# --- walk-forward --------------------------------------------------------------

def _lag_bound(ar: ArSpec) -> int:
    return ar.longest_lags if ar.kpss_lags is None else ar.kpss_lags


def _window_lags(spec: FoldSpec, ar: ArSpec, d: int) -> int:
    """Lags of the level test of a sliding fold, whose length is known."""
    if ar.kpss_lags is not None:
        return ar.kpss_lags
    return int(math.sqrt(spec.window_size - spec.validation_size - d) * 3.0 / 13.0)


def window_level_tests(rows: DataFrame, spec: FoldSpec, ar: ArSpec) -> DataFrame:
    """Level test ``_level{d}`` of the fold of each row, for sliding windows.

    With C the running total of the targets, m a fold's mean and l the lags, the Bartlett
    long-run variance is the sum of squares of the l + 1 rows' moving sums of
    deviations, with nothing beyond the ends of the fold, over l + 1. Inside the fold a moving sum is a
    difference of two totals; the l partial sums at either end start or end at the fold's own end.
    All of them, and the test's own partial sums, are squares of C - base - m k, so the sums of
    C, C^2 and k C over the fold, its first l and its last l rows are enough at any l.
    """
    start = F.col("block") * spec.block_size
    for d in ar.differences[:-1]:
        lags = _window_lags(spec, ar, d)
        back, skip = spec.window_size - 1 - d, spec.withheld
        n = back - skip + 1
        v = F.when(F.col("i") >= spec.prediction_length + d, F.coalesce(F.col(f"d{d}_v_all"), F.lit(0.0))).otherwise(F.lit(0.0))
        order = in_block()
        rows = rows.withColumn("_total", F.sum(v).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        total, at = F.col("_total"), (F.col("i") - start).cast("double")
        moving = total - F.coalesce(F.lag("_total", lags + 1).over(order), F.lit(0.0))
        rows = rows.withColumns({"_c": total, "_cc": total * total, "_kc": at * total, "_m": moving})
        rows = rows.withColumn("_mm", F.col("_m") * F.col("_m"))
        ends = {"_before": F.lag("_total", back + 1).over(order), "_last": F.lag("_total", skip).over(order) if skip else total}
        if lags:
            head, tail = order.rowsBetween(-back, lags - 1 - back), order.rowsBetween(-skip - lags, -skip - 1)
            ends |= {f"_head{c}": F.sum(c).over(head) for c in ("_c", "_cc", "_kc", "_m", "_mm")}
            ends |= {f"_tail{c}": F.sum(c).over(tail) for c in ("_c", "_cc", "_kc")}
        rows = rows.withColumns(ends).withColumn("seg", F.floor(F.col("i") / n))
        rows = frames.sliding(rows, Sums(("_c", "_cc", "_kc", "_m", "_mm")), back, skip, "_fold")
        base, last, fold = F.coalesce("_before", F.lit(0.0)), F.col("_last"), F.col("_fold")
        mean = (last - base) / float(n)

        def squares(c: Column, cc: Column, kc: Column, count: float, from_: Column, zero: Column, k: float, kk: float) -> Column:
            """Sum of (C - from_ - mean * (at - zero))^2 over ``count`` rows, whose at - zero sum to k, and squared to kk."""
            return cc - 2.0 * from_ * c + count * from_ * from_ - 2.0 * mean * (kc - zero * c - from_ * k) + mean * mean * kk

        first, m = at - float(back + 1), lags
        steps = squares(fold["_c"], fold["_cc"], fold["_kc"], n, base, first, n * (n + 1) / 2.0, n * (n + 1) * (2.0 * n + 1) / 6.0)
        inner, inner2 = fold["_m"], fold["_mm"]
        edges = F.lit(0.0)
        if lags:
            k, kk = m * (m + 1) / 2.0, m * (m + 1) * (2.0 * m + 1) / 6.0
            edges = squares(*(F.col(f"_head{c}") for c in ("_c", "_cc", "_kc")), m, base, first, k, kk)
            edges = edges + squares(*(F.col(f"_tail{c}") for c in ("_c", "_cc", "_kc")), m, last, at - float(skip), -k, kk)
            inner, inner2 = inner - F.col("_head_m"), inner2 - F.col("_head_mm")
        wide = (m + 1) * mean
        spread = (inner2 - 2.0 * wide * inner + float(n - m) * wide * wide + edges) / float(m + 1)
        # what rounding leaves of a constant series is no variance
        known = F.when(spread > 1e-13 * (fold["_cc"] + base * base), spread)
        rows = rows.withColumn(f"_level{d}", F.try_divide(steps, n * known))
        rows = rows.drop("_total", "_c", "_cc", "_kc", "_m", "_mm", "_fold", "_nseg", *ends)
    return rows


def growing_test_numbers(d: int, lags: int, spec: FoldSpec) -> Column:
    """What is summed over a growing fold for its level test: needs ``_k{d}`` and its running total ``_c{d}``."""
    rank = F.col("i") - (spec.prediction_length + d) + 1
    v, c, recent = F.col(f"_k{d}"), F.col(f"_c{d}"), F.col(f"_lags{d}")
    steps = F.sequence(F.lit(1), F.lit(lags)) if lags else F.array().cast("array<int>")
    own = F.array(F.lit(1.0), v, v * v, c * c, rank * c)
    pairs = F.transform(steps, lambda s: v * F.coalesce(F.get(recent, s), F.lit(0.0)))
    heads = F.transform(steps, lambda s: F.when(rank <= s, v).otherwise(F.lit(0.0)))
    return F.when(rank >= 1, F.concat(own, pairs, heads)).otherwise(F.array_repeat(F.lit(0.0), 5 + 2 * lags))


def growing_level(numbers: Column, tail: Column, bound: int, lags: int | None) -> Column:
    """Level statistic from the sums and ``tail``, the newest values of the fold, latest first."""
    def at(k) -> Column:
        return F.get(numbers, k if isinstance(k, Column) else F.lit(k))

    n, total, squares_v, cc, rc = (at(k) for k in range(5))
    mean = F.try_divide(total, n)
    squares = cc - 2.0 * mean * rc + mean * mean * n * (n + 1.0) * (2.0 * n + 1.0) / 6.0
    bandwidth = kpss_lag_rule(n).cast("double") if lags is None else F.lit(float(lags))

    def step(state: Column, s: Column) -> Column:
        until = state["until"] - F.coalesce(F.get(tail, s - 1), F.lit(0.0))  # total up to s rows before the end
        paired = (total - at(s + (4 + bound))) + until
        gamma = at(s + 4) - mean * paired + (n - s) * mean * mean
        weight = F.when(s <= bandwidth, 1.0 - s / (bandwidth + 1.0)).otherwise(F.lit(0.0))
        return F.struct(until.alias("until"), (state["sum"] + 2.0 * weight * gamma).alias("sum"))

    start = F.struct(total.alias("until"), (squares_v - n * mean * mean).alias("sum"))
    long_run = F.aggregate(F.sequence(F.lit(1), F.lit(bound)), start, step, lambda s: s["sum"]) if bound else start["sum"]
    return F.try_divide(squares, n * long_run)


def forecast_steps(fit: Column, recent: Column, level: Column, slope: Column, exog: Column) -> Column:
    """Apply the recursion once per entry of ``exog``; the last forecast.

    ``recent`` holds the newest differenced targets, latest first. For d = 0
    the forecast is the recursion itself, for d = 1 and 2 it is summed up from
    ``level`` (last target) and ``slope`` (last first difference).
    """
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, u: Column) -> Column:
        v = fit["intercept"] + dot(fit["beta"], u) + dot(fit["phi"], state["recent"])
        keep = F.slice(state["recent"], F.lit(1), F.size(state["recent"]) - 1)
        slope_next = F.when(fit["d"] == 2, state["slope"] + v).otherwise(v)
        level_next = F.when(fit["d"] == 0, v).otherwise(state["level"] + slope_next)
        return F.struct(
            F.concat(F.array(v), keep).alias("recent"), level_next.alias("level"), slope_next.alias("slope")
        )

    start = F.struct(recent.alias("recent"), level.alias("level"), slope.alias("slope"))
    return F.aggregate(exog, start, step, lambda s: s["level"])


def differenced(values: Column, d: int, count: int) -> Column:
    """The first ``count`` d-th differences of values that are latest first."""
    part = [F.slice(values, k + 1, count) for k in range(d + 1)]
    if d == 0:
        return part[0]
    if d == 1:
        return F.zip_with(part[0], part[1], lambda a, b: a - b)
    return F.zip_with(F.zip_with(part[0], part[1], lambda a, b: a - 2.0 * b), part[2], lambda a, c: a + c)


def array_fits(sums: Column, spec: FoldSpec, ar: ArSpec, d: int, exogs: int) -> Column:
    """The order of least AIC from the summed triangle of ``[1, inputs, lags, target]``."""
    m = exogs + ar.max_p + 1
    flat = F.col(f"_cov{d}")
    mean, n = F.col(f"_mean{d}"), F.get(sums, F.lit(0))
    states = swept(flat, m, list(range(m - 1)))

    def candidate(state: Column, at: Column) -> Column:
        p = at - F.lit(exogs - 1)
        rss = F.get(state, F.lit(m * m - 1))
        coef = F.transform(
            F.sequence(F.lit(0), F.lit(m - 2)), lambda f: F.when(f - exogs < p, F.get(state, f * m + m - 1)).otherwise(F.lit(0.0))
        )
        intercept = F.get(mean, F.lit(m - 1)) - F.aggregate(F.zip_with(coef, F.slice(mean, 1, m - 1), lambda c, u: c * u), F.lit(0.0), lambda s, x: s + x)
        fit = F.when(rss > 0, n * F.ln(rss / n)).otherwise(F.lit(float("-inf")))
        return F.struct(
            (fit + 2.0 * (p + F.lit(exogs + 1))).alias("aic"), p.cast("bigint").alias("p"), F.lit(d).alias("d"), n.alias("n"), rss.alias("rss"),
            intercept.alias("intercept"), F.slice(coef, 1, exogs).alias("beta"), F.slice(coef, exogs + 1, ar.max_p).alias("phi"),
        )

    every = F.slice(F.transform(states, candidate), exogs, ar.max_p + 1)
    # the struct starts with (aic, p): least AIC, ties to the smaller order
    return F.when(n > 0, F.array_min(every))


def autoregressive_forecasts(
    prices: DataFrame, spec: FoldSpec = AUTOREGRESSIVE, ar: ArSpec = ArSpec(), model: str = "arima"
) -> DataFrame:
    """Walk-forward forecasts of the order with the least AIC.

    The newest known target at row e is that of row e-V, so P+V steps lead to
    row e+P; their inputs are all known at e. ``compat`` instead repeats P
    steps from the end of the last training set, with the inputs of the rows
    being scored. Lags are arrays, and only refits are fitted, so the plan does not grow with lags or steps.
    """
    if spec.random_validation:
        raise ValueError("autoregressions withhold the newest rows")
    p_ahead, v, exogs, deepest = spec.prediction_length, spec.validation_size, spec.lags, max(ar.differences)
    steps = p_ahead if ar.compat else p_ahead + v
    testing, growing_test = ar.difference is None, ar.difference is None and not spec.sliding_window
    if growing_test and ar.kpss_lags is None and ar.longest_lags is None:
        longest = prices.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
        ar = replace(ar, longest_lags=int(math.sqrt(longest) * 3.0 / 13.0))
    bound = _lag_bound(ar) if growing_test else _window_lags(spec, ar, 0) + 1 if testing else 0
    spec = spec.but(extra_rows=ar.max_p + deepest + p_ahead + v + bound)
    # rows of a fold reach its fit as sums; only the level test of a sliding window looks back over it
    plain = spec if testing and spec.sliding_window else spec.but(sliding_window=False)
    rows = fold_rows(prices, plain)
    order, tested = in_block(), ar.differences[:-1] if testing else []
    for d in tested:
        rows = rows.withColumn(f"d{d}_v_all", _differenced("y_l", d, order))
    if testing and spec.sliding_window:
        rows = window_level_tests(rows, spec, ar)
    elif testing:
        rank = F.col("i") - p_ahead + 1
        rows = rows.withColumns({f"_k{d}": F.when(rank - d >= 1, F.coalesce(F.col(f"d{d}_v_all"), F.lit(0.0))) for d in tested})
        rows = rows.withColumns({f"_lags{d}": window_of(f"_k{d}", bound + 1) for d in tested} | {f"_tail{d}": window_of(f"_k{d}", max(bound, 1), v) for d in tested})
    rows = rows.drop(*[f"d{d}_v_all" for d in tested])
    exog = [window_of(x, deepest + 1) for x in spec.train_inputs]
    rows = rows.withColumns(
        {"_ys": window_of("y_l", ar.max_p + deepest + 1), "_known": window_of("y_l", ar.max_p + deepest + 1, v)}
        | {f"_u{k}": u for k, u in enumerate(exog)}
        | {f"_coming{k}": window_of(x, steps + deepest) for k, x in enumerate(spec.inputs)}
    )

    # sums over the training rows of every refit
    own = rows.where("own")
    if growing_test:
        own = running_totals(own, {f"_c{d}": F.col(f"_k{d}") for d in tested})
    parts, sizes = [], []
    whole = (F.col("i") >= p_ahead + ar.max_p + deepest) & (F.size("_ys") == ar.max_p + deepest + 1)
    for d in ar.differences:
        lags = differenced(F.col("_ys"), d, ar.max_p + 1)
        vector = F.concat(F.array(F.lit(1.0)), *[differenced(F.col(f"_u{k}"), d, 1) for k in range(exogs)], F.slice(lags, 2, ar.max_p), F.slice(lags, 1, 1))
        width = exogs + ar.max_p + 2
        complete = whole & (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull())
        size = width * (width + 1) // 2
        parts.append(F.when(complete, products(vector)).otherwise(F.array_repeat(F.lit(0.0), size)))
        sizes.append(size)
    if growing_test:
        parts += [growing_test_numbers(d, bound, spec) for d in tested]
        sizes += [5 + 2 * bound] * len(tested)
    sums = refit_sums(own.withColumn("_p", F.concat(*parts)), spec, ar.max_p + deepest)
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    pieces = [F.slice("_sums", at + 1, size) for at, size in zip(starts, sizes)]

    # what a refit takes from its own row
    carried = [f"_level{d}" for d in tested] if spec.sliding_window else [f"_tail{d}" for d in tested]
    carried += ["_known"] if ar.compat else []
    fits = sums
    if carried:
        at_refit = rows.where(F.col("own") & refits(spec)).select("series_id", F.col("t").alias("refit_t"), *carried)
        fits = fits.join(at_refit, ["series_id", "refit_t"])
    width = exogs + ar.max_p + 1
    for k, d in enumerate(ar.differences):
        fits = fits.withColumn(f"_mean{d}", means(pieces[k], width))
        fits = fits.withColumn(f"_cov{d}", F.transform(centred(pieces[k], F.col(f"_mean{d}"), width), lambda c: c))
        # rounding left of a constant column is not variance
        diagonal = n_squares(pieces[k], F.col(f"_mean{d}"), width)
        fits = fits.withColumn(f"_cov{d}", F.transform(f"_cov{d}", lambda c, i: F.when((F.pmod(i, F.lit(width + 1)) == 0) & (c <= F.get(diagonal, F.floor(i / width).cast("int"))), F.lit(0.0)).otherwise(c)))  # noqa: B023
        fits = fits.withColumn(f"fit{d}", array_fits(pieces[k], spec, ar, d, exogs))
    if testing:
        picks = []
        for k, d in enumerate(tested):
            level = F.col(f"_level{d}") if spec.sliding_window else growing_level(pieces[len(ar.differences) + k], F.col(f"_tail{d}"), bound, ar.kpss_lags)
            # a constant series is stationary
            picks.append(F.when(F.coalesce(level < KPSS_CRITICAL[ar.alpha], F.lit(True)), F.lit(d)))
        fits = fits.withColumn("_d", F.coalesce(*picks, F.lit(ar.differences[-1])))
        chosen = F.coalesce(*[F.when(F.col("_d") == d, F.col(f"fit{d}")) for d in ar.differences])
    else:
        chosen = F.col(f"fit{ar.difference}")
    fits = fits.select("series_id", "refit_t", chosen.alias("fit"), *(["_known"] if ar.compat else []))

    rows = rows.withColumn("refit_t", F.col("t") - F.pmod(F.col("t"), F.lit(spec.frequency)))
    kept = ["series_id", *BLOCK[1:], "own", "dt", "i", "n", "y", "t", "refit_t", *(f"_coming{k}" for k in range(exogs)), *([] if ar.compat else ["_known"])]
    rows = rows.select(*kept).join(fits, ["series_id", "refit_t"], "left")
    fit, known = F.col("fit"), F.col("_known")
    ready = fit.isNotNull() & (F.size(known) == ar.max_p + deepest + 1) & (F.size("_coming0") == steps + deepest)

    def path(d: int) -> Column:
        """Inputs of the steps in time order."""
        columns = [differenced(F.col(f"_coming{k}"), d, steps) for k in range(exogs)]
        return F.reverse(F.transform(columns[0], lambda u, i: F.array(u, *[F.get(c, i) for c in columns[1:]])))

    level, before = F.get(known, F.lit(0)), F.get(known, F.lit(1))
    made = [
        F.when(ready & (fit["d"] == d), forecast_steps(fit, differenced(known, d, ar.max_p), level, level - before, path(d)))
        for d in ar.differences
    ]
    return land(rows.withColumn("forecast", F.coalesce(*made)), plain, model)


def n_squares(sums: Column, mean: Column, width: int) -> Column:
    """n times squared means, in units of what rounding may leave of them."""
    return F.transform(mean, lambda m: F.get(sums, F.lit(0)) * m * m * 1e-20)


# --- single split ----------------------------------------------------------------

@dataclass(frozen=True)
class _Orders:
    """Orders as ``ahead_of_training`` reads them: no errors."""

    max_p: int
    max_q: int = 0
    long_order: int = 0


@dataclass(frozen=True)
class _Plain:
    arma: _Orders


def autoregressive_split(
    prices: DataFrame, ar: ArSpec = ArSpec(), split: SplitSpec = SplitSpec(lags=1), model: str = "arima"
) -> DataFrame:
    """Fit once, then forecast every later row recursively from the end of training."""
    wide = SplitSpec(max(ar.max_p, split.lags), split.test_size, split.validation_size, split.block_rows)
    best = order_search(prices, ar, split).where("chosen = 1").select("series_id", "intercept", "beta", "phi")
    fits = best.withColumn("theta", F.array().cast("array<double>"))
    return ahead_of_training(split_rows(prices, wide), fits, split, model, _Plain(_Orders(ar.max_p)))

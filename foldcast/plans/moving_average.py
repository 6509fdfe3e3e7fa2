"""Regressions with moving-average terms, by two-stage least squares.

Hannan and Rissanen (1982): a long autoregression gives residuals, then the
target is regressed on its own lags, lagged residuals and the inputs. A lagged
residual is a linear form in lagged targets and inputs, so both stages follow
from one moment summary of a fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.functions.regression import swept
from foldcast.functions.triangles import centred, means, products
from foldcast.operators.folds import AUTOREGRESSIVE, FoldSpec, fold_rows, land
from foldcast.operators.sums import gathered, refit_sums, summed, window_of
from foldcast.plans.affine import ahead_of_training, dot
from foldcast.plans.single_split import SplitSpec, split_rows

@dataclass(frozen=True)
class ArmaSpec:
    """Orders searched: p <= max_p, q <= max_q, p + q <= max_order."""

    max_p: int = 5
    max_q: int = 5
    max_order: int = 5
    long_order: int = 6

    def __post_init__(self) -> None:
        if self.max_p < 1 or self.max_q < 1 or self.long_order < self.max_p:
            raise ValueError("orders must be at least 1 and the long order at least max_p")


def settles(coefficients: Column) -> Column:
    """Whether all roots of z^m + a1 z^(m-1) + ... + am lie inside the unit circle, by Levinson's recursion run backwards."""

    def step(state: Column, _) -> Column:
        a, k = state["a"], F.element_at(state["a"], -1)
        lower = F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda v, i: F.try_divide(v - k * F.get(a, F.size(a) - 2 - i), 1.0 - k * k))
        return F.struct(lower.alias("a"), (state["inside"] & (F.abs(k) < 1.0)).alias("inside"))

    start = F.struct(coefficients.alias("a"), F.lit(True).alias("inside"))
    inside = F.aggregate(coefficients, start, step, lambda s: F.coalesce(s["inside"], F.lit(False)))
    return F.when(F.size(coefficients) == 0, F.lit(True)).otherwise(inside)


class Layout:
    """Places of the lags in a row's vector: 1, the target and its lags, every input and its lags."""

    def __init__(self, inputs: int, arma: ArmaSpec) -> None:
        self.inputs, self.arma = inputs, arma
        self.depth = arma.long_order + arma.max_q
        self.width = self.depth + 1 + inputs * (arma.max_q + 1)

    def lag(self, a: int) -> int:
        return a

    def exog(self, k: int, j: int) -> int:
        return self.depth + 1 + k * (self.arma.max_q + 1) + j


def with_fits(grouped: DataFrame, layout: Layout) -> DataFrame:
    """Add ``fit``, the orders of least AIC whose forecasts settle, to rows with the summed triangle ``_sums``.

    Ties go to fewer terms, then to fewer own lags. A lag that depends on the columns before it gets 0.
    """
    arma, width, inputs = layout.arma, layout.width, layout.inputs
    m = arma.long_order
    # long autoregression
    now = [layout.exog(k, 0) for k in range(inputs)]
    first = [*now, *[layout.lag(a) for a in range(1, m + 1)], layout.lag(0)]
    n, s = F.get(F.col("_sums"), F.lit(0)), {"mean": F.col("_mean"), "cov": F.col("_cov")}
    rows = grouped.withColumn("_mean", means(F.col("_sums"), width)).withColumn("_cov", centred(F.col("_sums"), s["mean"], width))
    long = F.array(*[s["cov"][a * width + b] for a in first for b in first])
    rows = rows.withColumn("_long", F.transform(long, lambda v: v))
    swept_long = F.element_at(swept(F.col("_long"), len(first), list(range(len(first) - 1))), -1)
    rows = rows.withColumn("_swept", swept_long)
    last = F.array(*[F.col("_swept")[k * len(first) + len(first) - 1] for k in range(len(first) - 1)])
    # no-op transforms keep the optimizer from copying every entry into every use
    rows = rows.withColumn("_coef", F.transform(last, lambda v: v))
    coef = F.col("_coef")
    reach = s["mean"][0]
    for k, place in enumerate(first[:-1]):
        reach = reach - coef[k] * s["mean"][place]
    rows = rows.withColumn("_long_c", reach)
    # every regressor of the second stage as a form in the vector's places
    zero, one = F.lit(0.0), F.lit(1.0)
    forms = [{place: one} for place in now] + [{layout.lag(a): one} for a in range(1, arma.max_p + 1)]
    for j in range(1, arma.max_q + 1):
        form = {layout.lag(j): one}
        form |= {layout.exog(k, j): -coef[k] for k in range(inputs)}
        form |= {layout.lag(j + a): -coef[inputs + a - 1] for a in range(1, m + 1)}
        forms.append(form)
    forms.append({layout.lag(0): one})
    size = len(forms)
    rows = rows.withColumn("_forms", F.transform(F.array(*[F.array(*[f.get(c, zero) for c in range(width)]) for f in forms]), lambda f: f))
    columns = F.sequence(F.lit(0), F.lit(width - 1))
    half = F.transform("_forms", lambda f: F.transform(columns, lambda c: dot(f, F.slice(s["cov"], c * width + 1, F.lit(width)))))
    rows = rows.withColumn("_half", half)
    rows = rows.withColumn("_gram", F.flatten(F.transform("_half", lambda h: F.transform("_forms", lambda f: dot(h, f)))))
    rows = rows.withColumn("_means", F.transform("_forms", lambda f: dot(f, s["mean"])))
    candidates = []
    for p in range(arma.max_p + 1):
        most = min(arma.max_q, arma.max_order - p)
        places = [*range(inputs + p), *range(inputs + arma.max_p, inputs + arma.max_p + most)]
        rows = rows.withColumn(f"_s{p}", swept(F.col("_gram"), size, places))
        for q in range(most + 1):
            state = F.col(f"_s{p}")[inputs + p + q - 1]
            used = places[: inputs + p + q]
            value = {k: state[k * size + size - 1] for k in used}
            c = F.col("_means")[size - 1]
            for k in used:
                c = c - value[k] * F.col("_means")[k]
            theta = [value.get(inputs + arma.max_p + j, zero) for j in range(arma.max_q)]
            for v in theta[:q]:
                c = c + v * F.col("_long_c")  # the mean of a residual lacks the long intercept
            phi = [value.get(inputs + a, zero) for a in range(arma.max_p)]
            rss = state[size * size - 1]
            aic = F.when(rss > 0, n * F.ln(rss / n) + 2.0 * (p + q + inputs + 1)).otherwise(F.lit(float("-inf")))
            candidates.append(
                F.struct(
                    F.round(aic, 9).alias("key"), F.lit(p + q).alias("terms"), F.lit(p).alias("p"), F.lit(q).alias("q"), aic.alias("aic"), c.alias("intercept"),
                    F.array(*[value[k] for k in range(inputs)]).alias("beta"), F.array(*phi).alias("phi"), F.array(*theta).alias("theta"),
                )
            )
    rows = rows.withColumn("_every", F.transform(F.array(*candidates), lambda c: c))
    steady = F.filter("_every", lambda c: settles(F.transform(c["phi"], lambda v: -v)) & settles(c["theta"]))
    long_part = {"long_intercept": F.col("_long_c"), "long_beta": F.slice(coef, 1, inputs), "long_phi": F.slice(coef, inputs + 1, m)}
    best = F.array_min(steady)
    fields = [best[f].alias(f) for f in ("aic", "p", "q", "intercept", "beta", "phi", "theta")] + [n.alias("n")]
    fit = F.struct(*fields, *[c.alias(name) for name, c in long_part.items()])
    rows = rows.withColumn("fit", F.when(n > width, fit))
    return rows.select(*[c for c in rows.columns if not c.startswith("_")])


def moving_average_forecasts(
    prices: DataFrame, spec: FoldSpec = AUTOREGRESSIVE, arma: ArmaSpec = ArmaSpec(), model: str = "arma"
) -> DataFrame:
    """Walk-forward forecasts, P+V steps from the newest known target at each row; sliding or growing windows."""
    if spec.random_validation:
        raise ValueError("autoregressions withhold the newest rows")
    p_ahead, v = spec.prediction_length, spec.validation_size
    layout = Layout(spec.lags, arma)
    depth = layout.depth
    spec = spec.but(extra_rows=depth + p_ahead + v)
    # rows of a fold reach the fit as sums, so blocks look back no further than lags and landing
    plain = spec.but(sliding_window=False)
    rows = fold_rows(prices, plain)
    lists = [window_of("y_l", depth + 1), *[window_of(x, arma.max_q + 1) for x in spec.train_inputs]]
    vector = F.concat(F.array(F.lit(1.0)), *lists)
    # what the recursion starts from, as of each row
    known = window_of("y_l", depth + 1, v)
    seen = F.array(*[window_of(x, arma.max_q, v) for x in spec.train_inputs])
    coming = F.reverse(F.arrays_zip(*[window_of(x, p_ahead + v).alias(x) for x in spec.inputs]))
    rows = rows.withColumns({"_all": vector, "known": known, "seen": seen, "coming": coming})
    rows = rows.withColumn("_v", F.when((F.col("i") >= p_ahead + depth) & (F.size("_all") == layout.width + 1) & F.forall("_all", lambda x: x.isNotNull()), F.col("_all")))
    rows = rows.withColumn("coming", F.transform("coming", lambda u: F.array(*[u[x] for x in spec.inputs]))).drop("_all")
    vectors = rows.where("own").where(F.col("_v").isNotNull()).withColumn("_p", products(F.col("_v")))
    fits = with_fits(refit_sums(vectors, spec, depth), layout)
    rows = rows.drop("_v").withColumn("refit_t", F.col("t") - F.pmod(F.col("t"), F.lit(spec.frequency)))
    rows = rows.join(fits, ["series_id", "refit_t"], "left")
    return land(rows.withColumn("forecast", _recursion(arma, len(spec.inputs))), plain, model)


def moving_average_split(
    prices: DataFrame, arma: ArmaSpec = ArmaSpec(), split: SplitSpec = SplitSpec(lags=1), model: str = "arma"
) -> DataFrame:
    """Fit once on the training rows, then forecast every later row from the end of training."""
    layout = Layout(split.lags, arma)
    rows = split_rows(prices, SplitSpec(layout.depth + split.lags, split.test_size, split.validation_size, split.block_rows))
    # lags of the target are the lagged returns themselves, and so are lags of the inputs
    lags = [F.col("y"), *[F.col(f"x{a}") for a in range(1, layout.depth + 1)]]
    exog = [F.col(f"x{split.lags - k + j}") for k in range(split.lags) for j in range(arma.max_q + 1)]
    usable = (F.col("role") == "train") & (F.col("i") >= layout.depth)
    vectors = rows.where(usable).select("series_id", products(F.array(F.lit(1.0), *lags, *exog)).alias("_p"))
    fits = with_fits(gathered(summed(vectors, ["series_id"]), ["series_id"]), layout)
    return ahead_of_training(rows, fits.select("series_id", "fit.*").drop("n"), split, model, layout)


def _recursion(arma: ArmaSpec, inputs: int) -> Column:
    fit, known = F.col("fit"), F.col("known")
    errors = []
    for j in range(arma.max_q):
        past = F.slice(known, j + 2, arma.long_order)
        told = F.lit(0.0)
        for k in range(inputs):
            told = told + F.get(fit["long_beta"], F.lit(k)) * F.get(F.col("seen")[k], F.lit(j))
        errors.append(F.get(known, F.lit(j)) - fit["long_intercept"] - told - dot(fit["long_phi"], past))

    def shifted(a: Column, new: Column) -> Column:
        return F.concat(F.array(new), F.slice(a, F.lit(1), F.size(a) - 1))

    def step(state: Column, u: Column) -> Column:
        y = (
            fit["intercept"] + dot(fit["beta"], u) + dot(fit["phi"], state["recent"])
            + dot(fit["theta"], state["errors"])
        )
        return F.struct(
            shifted(state["recent"], y).alias("recent"),
            shifted(state["errors"], F.lit(0.0)).alias("errors"),
            y.alias("y"),
        )

    start = F.struct(
        F.slice(known, 1, arma.max_p).alias("recent"), F.array(*errors).alias("errors"), F.get(known, F.lit(0)).alias("y")
    )
    # rows copied to a block without all they look back on are not scored there
    whole = fit.isNotNull() & (F.size(known) == arma.long_order + arma.max_q + 1) & (F.size(F.col("seen")[0]) == arma.max_q)
    return F.when(whole, F.aggregate(F.col("coming"), start, step, lambda s: s["y"]))

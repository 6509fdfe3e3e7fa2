"""Least squares from moments, as column expressions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.functions.summaries import Moments

# A feature whose variance, after the others are taken out, falls below this
# share of its own variance counts as dependent on them.
DEPENDENT = 1e-12


def swept(matrix: Column, size: int, pivots: list[int], keep_left_out: bool = False) -> Column:
    """States of the symmetric sweep of a flat ``size`` x ``size`` matrix, one per pivot.

    After a set of features has been swept, the target's column holds their
    coefficients and the target's own cell the residual sum of squares, so one
    pass gives every nested regression. A dependent feature is not swept; its
    coefficient is 0, or with ``keep_left_out`` its column goes on to hold what it
    is on the swept ones. Returns an array of the matrices after each pivot.
    """
    zero = F.lit(0.0)

    def step(states: Column, p: Column) -> Column:
        a, own = F.element_at(states, -1), F.get(F.get(states, F.lit(0)), p * size + p)
        d = F.get(a, p * size + p)
        inverse = F.when(d > own * DEPENDENT, F.try_divide(F.lit(1.0), d))

        def moved(inv: Column) -> Column:
            def cell(v: Column, k: Column) -> Column:
                i, j = F.floor(k / size).cast("int"), F.pmod(k, F.lit(size))
                cross = F.get(a, i * size + p) * F.get(a, p * size + j)
                on = (
                    F.when((i == p) & (j == p), -inv)
                    .when((i == p) | (j == p), v * inv)
                    .otherwise(v - cross * inv)
                )
                # a feature left out must not act on the later ones
                kept = v if keep_left_out else F.when((i == p) | (j == p), zero).otherwise(v)
                return F.when(inv.isNotNull(), on).otherwise(kept)

            return F.transform(a, cell)

        # an expression inside a function is evaluated wherever it is used: as an argument it is evaluated once
        return F.concat(states, F.transform(F.array(inverse), moved))

    order = F.array(*[F.lit(p) for p in pivots])
    return F.aggregate(order, F.array(matrix), step, lambda states: F.slice(states, 2, len(pivots)))


def _minimum_norm(features: list[str], g, r) -> list[Column]:
    """Shortest solution when up to three features are linearly dependent.

    On the range of a singular matrix G its characteristic polynomial gives the
    inverse: rank 1 is r / tr(G), rank 2 is (tr(G) r - G r) / c2.
    """
    trace = sum((g(a, a) for a in features[1:]), g(features[0], features[0]))
    if len(features) == 2:
        return [F.coalesce(F.try_divide(r(a), trace), F.lit(0.0)) for a in features]
    minors = [g(a, a) * g(b, b) - g(a, b) * g(a, b) for a, b in combinations(features, 2)]
    c2 = minors[0] + minors[1] + minors[2]
    out = []
    for a in features:
        g_r = sum((g(a, b) * r(b) for b in features[1:]), g(a, features[0]) * r(features[0]))
        rank_two = F.try_divide(trace * r(a) - g_r, c2)
        rank_one = F.try_divide(r(a), trace)
        out.append(F.coalesce(F.when(c2 > trace * trace * DEPENDENT, rank_two).otherwise(rank_one), F.lit(0.0)))
    return out


def _shortest(last: Column, m: int) -> Column:
    """Shortest coefficients of ``m`` features from the last state of a sweep that kept what was left out.

    With c the coefficients of the swept features and T what the others are on
    them, the shortest vector with the same forecasts is z on the swept ones and
    T'z on the others, where (I + TT') z = c.
    """
    size = m + 1

    def cell(i: int, j: int) -> Column:
        return last[i * size + j]

    on = [cell(k, k) < 0.0 for k in range(m)]  # a sweep turns its pivot's sign
    zero, one = F.lit(0.0), F.lit(1.0)
    # T, 0 where a row is not swept or a column is
    t = [[F.when(on[i] & ~on[d], cell(i, d)).otherwise(zero) for d in range(m)] for i in range(m)]
    cells = []
    for i in range(m):
        for j in range(m):
            cells.append(sum((t[i][d] * t[j][d] for d in range(m)), one if i == j else zero))
        cells.append(F.when(on[i], cell(i, m)).otherwise(zero))
    cells += [cells[i * size + m] for i in range(m)] + [zero]
    regular = on[0]
    for k in range(1, m):
        regular = regular & on[k]
    solved = F.element_at(swept(F.transform(F.array(*cells), lambda v: v), size, list(range(m))), -1)
    z = F.array(*[solved[i * size + m] for i in range(m)])

    def on_others(z: Column) -> Column:
        spread = [sum((t[s][d] * z[s] for s in range(m)), zero) for d in range(m)]
        return F.array(*[F.when(on[d], z[d]).otherwise(spread[d]) for d in range(m)])

    shortest = F.transform(F.array(z), on_others)[0]
    return F.when(regular, F.array(*[cell(k, m) for k in range(m)])).otherwise(shortest)


def least_squares(
    df: DataFrame,
    moments: Moments,
    summary: str,
    features: list[str],
    target: str,
    fit_intercept: bool = True,
    positive: bool = False,
) -> DataFrame:
    """Add ``intercept`` and ``coef`` (array, in feature order) from a summary column."""
    s = F.col(summary)

    def entry(a: str, b: str) -> Column:
        centred = moments.c(s, a, b)
        return centred if fit_intercept else centred + s["n"] * s[f"m_{a}"] * s[f"m_{b}"]

    if positive and len(features) <= 3:
        coef = F.array(*_non_negative(features, target, entry))
        df = df.withColumn("coef", coef)
    elif positive:
        names = [*features, target]
        flat = F.transform(F.array(*[entry(a, b) for a in names for b in names]), lambda v: v)
        df = df.withColumn("_flat", flat).withColumn("coef", non_negative(F.col("_flat"), len(features))).drop("_flat")
    elif len(features) == 1:
        only = features[0]
        var = entry(only, only)
        slope = F.when(var > 0, F.try_divide(entry(only, target), var)).otherwise(F.lit(0.0))
        df = df.withColumn("coef", F.array(slope))
    elif len(features) == 2:
        beta, regular = _cramer(features, entry, lambda a: entry(a, target))
        shortest = _minimum_norm(features, entry, lambda a: entry(a, target))
        df = df.withColumn("coef", F.when(regular, F.array(*beta)).otherwise(F.array(*shortest)))
    else:
        names = [*features, target]
        size = len(names)
        # the no-op transform keeps the optimizer from copying every entry into every use
        flat = F.transform(F.array(*[entry(a, b) for a in names for b in names]), lambda v: v)
        df = df.withColumn("_flat", flat)
        last = F.element_at(swept(F.col("_flat"), size, list(range(size - 1)), keep_left_out=True), -1)
        df = df.withColumn("_last", last)
        coef = _shortest(F.col("_last"), size - 1)
        df = df.withColumn("coef", coef).drop("_flat", "_last")
    if not fit_intercept:
        return df.withColumn("intercept", F.when(s["n"] > 0, F.lit(0.0)))
    reach = s[f"m_{target}"]
    for k, f in enumerate(features):
        reach = reach - F.col("coef")[k] * s[f"m_{f}"]
    return df.withColumn("intercept", F.when(s["n"] > 0, reach))


def _non_negative(features: list[str], target: str, entry) -> list[Column]:
    """Best active set with all coefficients >= 0; up to three features."""
    zero = F.lit(0.0)
    options = [F.struct(F.lit(0.0).alias("gain"), *[zero.alias(f"b{k}") for k in range(len(features))])]
    for size in range(1, len(features) + 1):
        for active in combinations(features, size):
            beta, valid = _cramer(list(active), entry, lambda a: entry(a, target))
            gain = zero
            for a, b in zip(active, beta):
                valid = valid & (b >= 0)
                gain = gain + b * entry(a, target)
            cells = [
                (beta[active.index(f)] if f in active else zero).alias(f"b{k}")
                for k, f in enumerate(features)
            ]
            options.append(F.when(valid, F.struct(gain.alias("gain"), *cells)))
    best = F.array_max(F.array(*options))
    return [best[f"b{k}"] for k in range(len(features))]


def non_negative(matrix: Column, m: int) -> Column:
    """Least squares coefficients >= 0 from the flat matrix of centred products of ``m`` features and the target.

    Principal pivoting (Murty 1974): as long as a coefficient in the fit is negative, or one outside it
    would be positive, the last such feature leaves or enters, by a sweep or its reverse. No active set
    comes twice while features are independent, so at most 2^m steps are needed, and few in practice.
    A feature that depends on those in the fit does not enter.
    """
    size = m + 1
    features = F.sequence(F.lit(0), F.lit(m - 1))

    def own(k: Column) -> Column:
        return F.get(matrix, k * size + k)

    def wrong(state: Column) -> Column:
        def is_wrong(k: Column) -> Column:
            value = F.get(state["now"], k * size + m)
            enters = (value > F.sqrt(own(k) * F.get(matrix, F.lit(size * size - 1))) * DEPENDENT) & (
                F.get(state["now"], k * size + k) > own(k) * DEPENDENT
            )
            return F.when(F.get(state["fit"], k), value < 0.0).otherwise(enters)

        return F.array_max(F.filter(features, is_wrong))

    def step(state: Column, _) -> Column:
        p = state["next"]
        inverse = F.try_divide(F.lit(1.0), F.get(state["now"], p * size + p))
        side = F.when(F.get(state["fit"], p), -inverse).otherwise(inverse)

        def cell(v: Column, k: Column) -> Column:
            i, j = F.floor(k / size).cast("int"), F.pmod(k, F.lit(size))
            cross = F.get(state["now"], i * size + p) * F.get(state["now"], p * size + j)
            return F.when((i == p) & (j == p), -inverse).when((i == p) | (j == p), v * side).otherwise(v - cross * inverse)

        moved = F.struct(
            F.transform(state["now"], cell).alias("now"),
            F.transform(state["fit"], lambda on, k: F.when(k == p, ~on).otherwise(on)).alias("fit"),
        )
        return F.when(p.isNull(), state).otherwise(F.struct(moved["now"].alias("now"), moved["fit"].alias("fit"), wrong(moved).alias("next")))

    begin = F.struct(matrix.alias("now"), F.array_repeat(F.lit(False), m).alias("fit"))
    start = F.struct(begin["now"].alias("now"), begin["fit"].alias("fit"), wrong(begin).alias("next"))
    steps = F.sequence(F.lit(1), F.lit(min(2**m, 100 * m)))

    def finish(state: Column) -> Column:
        found = F.transform(features, lambda k: F.when(F.get(state["fit"], k), F.get(state["now"], k * size + m)).otherwise(F.lit(0.0)))
        return F.when(state["next"].isNull(), found).otherwise(F.raise_error(F.lit("no non-negative solution found")).cast("array<double>"))

    return F.aggregate(steps, start, step, finish)


def _cramer(active: list[str], g, r) -> tuple[list[Column], Column]:
    """Solution of up to three normal equations, and whether they are regular."""
    if len(active) == 1:
        (a,) = active
        return [F.try_divide(r(a), g(a, a))], g(a, a) > 0
    if len(active) == 2:
        a, b = active
        det = g(a, a) * g(b, b) - g(a, b) * g(a, b)
        regular = det > g(a, a) * g(b, b) * DEPENDENT
        return [
            F.try_divide(r(a) * g(b, b) - r(b) * g(a, b), det),
            F.try_divide(r(b) * g(a, a) - r(a) * g(a, b), det),
        ], regular

    def det3(m) -> Column:
        return (
            m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
            - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
            + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
        )

    matrix = [[g(p, q) for q in active] for p in active]
    det = det3(matrix)
    beta = []
    for k in range(3):
        swapped = [[r(active[i]) if j == k else matrix[i][j] for j in range(3)] for i in range(3)]
        beta.append(F.try_divide(det3(swapped), det))
    return beta, det > matrix[0][0] * matrix[1][1] * matrix[2][2] * DEPENDENT


def linear_score(coef: str, intercept: str, inputs: list[str]) -> Column:
    """Forecast of one row; NULL when an input is missing."""
    total = F.col(intercept)
    for k, name in enumerate(inputs):
        total = total + F.col(coef)[k] * F.col(name)
    return total

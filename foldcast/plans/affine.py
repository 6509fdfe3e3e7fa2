"""Recursive forecasts of long runs of rows: blocks as affine maps of the state they start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.operators.blocks import BLOCK, spread
from foldcast.operators.fanout import pack
from foldcast.plans.single_split import SplitSpec


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def times(a: Column, b: Column, size: int) -> Column:
    """Product of two flat matrices."""
    places = F.sequence(F.lit(0), F.lit(size - 1))
    columns = F.transform(places, lambda j: F.transform(places, lambda k: F.get(b, k * size + j)))
    return F.flatten(F.transform(places, lambda i: F.transform(columns, lambda c: dot(F.slice(a, i * size + 1, F.lit(size)), c))))


def apply(a: Column, v: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: dot(F.slice(a, i * size + 1, F.lit(size)), v))


def power(a: Column, n: Column, size: int) -> Column:
    """Flat matrix to a power, by squaring."""
    one = F.array(*[F.lit(float(i == j)) for i in range(size) for j in range(size)])

    def step(state: Column, bit: Column) -> Column:
        taken = F.when(F.shiftright(n.cast("bigint"), 0).bitwiseAND(F.pow(F.lit(2.0), bit).cast("bigint")) > 0, times(state["base"], state["made"], size)).otherwise(state["made"])
        return F.struct(taken.alias("made"), times(state["base"], state["base"], size).alias("base"))

    bits = F.sequence(F.lit(0), F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))), F.lit(0)).cast("int"))
    return F.aggregate(bits, F.struct(one.alias("made"), a.alias("base")), step, lambda s: s["made"])


def companion(phi: Column, theta: Column, p: int, q: int) -> Column:
    """How a row moves the state (newest p values, newest q errors) when it adds nothing and its own error is 0."""
    zero, one = F.lit(0.0), F.lit(1.0)
    first = [phi[a] for a in range(p)] + [theta[j] for j in range(q)]
    rows = [first] + [[one if c == r - 1 else zero for c in range(p + q)] for r in range(1, p)]
    rows += [[one if j and c == p + j - 1 else zero for c in range(p + q)] for j in range(q)]
    return F.transform(F.array(*[cell for row in rows for cell in row]), lambda v: v)


def _step(fit: dict[str, Column], p: int, q: int, drive: Column, state: Column) -> tuple[Column, Column]:
    """Next value and state."""
    values, errors = F.slice(state, 1, p), F.slice(state, p + 1, q)
    y = drive + dot(fit["phi"], values) + (dot(fit["theta"], errors) if q else F.lit(0.0))
    kept = [F.array(y), F.slice(values, 1, p - 1)]
    if q:
        kept += [F.array(F.lit(0.0)), F.slice(errors, 1, q - 1)]
    return y, F.concat(*kept)


def ahead_of_training(rows: DataFrame, fits: DataFrame, split: SplitSpec, model: str, layout) -> DataFrame:
    """Forecasts of the test rows, each from the forecasts before it, beginning at the end of training.

    ``rows`` are split rows with as many lags as the fit looks back, ``fits`` has per series
    ``intercept, beta, phi, theta, long_intercept, long_beta, long_phi``. The recursion is linear in the state it
    starts from: a block is packed into one row and gives the state it ends in from
    nothing and the power of the companion matrix that moves a state through it. These
    maps are composed in order, one row a block, and all blocks then run side by side.
    """
    p, q, inputs = layout.arma.max_p, layout.arma.max_q, split.inputs
    size = p + q
    lengths = rows.groupBy("series_id").agg(F.max("n").alias("n"), F.count_if(F.col("role") == "train").alias("n_fit"))
    per_block = spread(fits.join(lengths, "series_id"), split.block_rows).drop("n")
    ahead = rows.where("role <> 'train'").join(per_block, list(BLOCK))
    drive = F.col("intercept")
    for k, x in enumerate(inputs):
        drive = drive + F.col("beta")[k] * F.col(x)
    # the newest values and long errors as of the first row ahead
    errors = []
    for j in range(1, q + 1):
        error = F.col(f"x{j}") - F.col("long_intercept")
        for k in range(len(inputs)):
            error = error - F.col("long_beta")[k] * F.col(f"x{split.lags - k + j}")
        for a in range(1, layout.arma.long_order + 1):
            error = error - F.col("long_phi")[a - 1] * F.col(f"x{j + a}")
        errors.append(error)
    starts = F.col("i") == F.col("n_fit")
    known = F.when(starts, F.array(*[F.col(f"x{a}") for a in range(1, p + 1)], *errors))
    rowwise = ahead.select(*BLOCK, "n", "i", "dt", "role", "y", drive.alias("drive"), known.alias("known"), "phi", "theta")
    packed = pack(rowwise, ["dt", "role", "y", "drive", "known"])
    packed = packed.join(per_block.select(*BLOCK, "phi", "theta"), list(BLOCK))
    fit = {"phi": F.col("phi"), "theta": F.col("theta")}
    start = F.element_at("known", 1)
    nothing = F.array_repeat(F.lit(0.0), size)

    def end_state(begin: Column) -> Column:
        return F.aggregate("drive", begin, lambda state, d: _step(fit, p, q, d, state)[1])

    moved = packed.withColumns({"start": start, "shift": end_state(F.coalesce(start, nothing))})
    # what comes before the first block of a series is in its start already
    through = F.when(F.col("start").isNull(), power(companion(fit["phi"], fit["theta"], p, q), F.size("drive"), size))
    maps = moved.select(*BLOCK, F.struct("block", "shift", through.alias("through")).alias("map"))
    chain = maps.groupBy("series_id").agg(F.sort_array(F.collect_list("map")).alias("maps"))

    def compose(state: Column, m: Column) -> Column:
        after = F.when(m["through"].isNull(), m["shift"]).otherwise(F.zip_with(apply(m["through"], state["now"], size), m["shift"], lambda a, b: a + b))
        made = F.struct(m["block"].alias("block"), state["now"].alias("begin"))
        return F.struct(after.alias("now"), F.concat(state["begins"], F.array(made)).alias("begins"))

    none = F.array().cast("array<struct<block:bigint,begin:array<double>>>")
    begins = F.aggregate("maps", F.struct(nothing.alias("now"), none.alias("begins")), compose, lambda s: s["begins"])
    begins = chain.select("series_id", F.explode(begins).alias("b")).select("series_id", "b.block", "b.begin")

    def run(state: Column, d: Column) -> Column:
        y, now = _step(fit, p, q, d, state["now"])
        return F.struct(now.alias("now"), F.concat(state["made"], F.array(y)).alias("made"))

    begin = F.coalesce(F.element_at("known", 1), F.col("begin"))
    made = F.aggregate("drive", F.struct(begin.alias("now"), F.array().cast("array<double>").alias("made")), run, lambda s: s["made"])
    out = packed.join(begins, list(BLOCK)).withColumn("pred", made)
    each = out.select("series_id", "n", F.col("first"), F.posexplode(F.arrays_zip("dt", "role", "y", "pred")).alias("k", "r"))
    return each.where("r.role = 'test'").select(
        "series_id", "r.dt", F.lit(model).alias("model"), (F.col("first") + F.col("k")).alias("i"), "n", "r.pred", F.col("r.y").alias("true")
    )

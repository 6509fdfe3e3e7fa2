"""Sums of arrays over the rows that each refit sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldcast.operators.blocks import in_block
from foldcast.operators.folds import FoldSpec


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Summed arrays ``_p`` of each group, one row per group and place; aggregated before they are shuffled."""
    return rows.select(*keys, F.posexplode("_p").alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.sum("_x").alias("_x"))


def gathered(summed_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One array ``_sums`` per group."""
    in_order = F.sort_array(F.collect_list(F.struct("_pos", "_x")))
    return summed_rows.groupBy(*keys).agg(F.transform(in_order, lambda e: e["_x"]).alias("_sums"))


def refit_sums(rows: DataFrame, spec: FoldSpec, depth: int) -> DataFrame:
    """``(series_id, refit_t, _sums)``: the arrays ``_p`` of the training rows of every refit, summed.

    ``rows`` are own rows ``(series_id, i, n, _p)``; a row looks back ``depth`` rows, all of which must lie
    in a sliding window. A row of a growing window goes into the first refit that sees it, and
    sums run on over the refits of a series, one row each; a row of a sliding window goes into each of its
    W / frequency refits.
    """
    p, v, w, f = spec.prediction_length, spec.validation_size, spec.window_size, spec.frequency
    begin = -(-w // f) * f
    # the target of row i is in the folds t with i <= t + P - 1 - V
    seen = F.greatest(F.ceil((F.col("i") - (p - 1) + v) / f) * f, F.lit(begin)).cast("bigint")
    ends = F.floor((F.col("n") - p) / f) * f
    keys = ["series_id", "refit_t"]
    if not spec.sliding_window:
        new = summed(rows.where(seen <= ends).select("series_id", seen.alias("refit_t"), "_p"), keys)
        so_far = Window.partitionBy("series_id", "_pos").orderBy("refit_t").rowsBetween(Window.unboundedPreceding, 0)
        return gathered(new.withColumn("_x", F.sum("_x").over(so_far)), keys)
    last = F.least(F.floor((F.col("i") - p - depth + w) / f) * f, ends).cast("bigint")
    dealt = rows.where(seen <= last).select("series_id", F.explode(F.sequence(seen, last, F.lit(f).cast("bigint"))).alias("refit_t"), "_p")
    return gathered(summed(dealt, keys), keys)


def window_of(column: str, rows: int, skip: int = 0) -> Column:
    """Values of ``rows`` rows of a block from ``skip`` rows back, latest first; missing ones stay in place."""
    frame = in_block().rowsBetween(-(rows - 1) - skip, -skip)
    return F.reverse(F.transform(F.collect_list(F.struct(F.col(column).alias("v"))).over(frame), lambda s: s["v"]))

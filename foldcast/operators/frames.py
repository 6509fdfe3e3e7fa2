"""Sliding and growing summaries over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldcast.operators.blocks import BLOCK, in_block, latest_first


def sliding(blocks: DataFrame, summary, back: int, skip: int, name: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Summary of rows ``[i-back, i-skip]`` at every row ``i``.

    Needs ``seg`` cut into runs of the frame length ``back-skip+1``. Any such
    frame is the tail of one run plus the head of the next (van Herk 1992), so
    two running passes replace re-aggregating every frame: the cost per row
    does not depend on the frame length and nothing is ever subtracted.
    Only rows with a full frame inside the block are right. ``extra`` adds
    columns over the ``latest_first`` order, computed in the same pass.
    """
    length = back - skip + 1
    run = Window.partitionBy(*BLOCK, "seg").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = blocks.withColumn("_head", summary.aggregate(run))
    head = head.withColumn("_nseg", -F.col("seg"))
    rest = (
        Window.partitionBy(*BLOCK, "_nseg")
        .orderBy(F.col("i").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    both = head.withColumn("_tail", summary.aggregate(rest))
    back_to = latest_first()
    both = both.withColumns(
        {"_head": F.lead("_head", skip).over(back_to), "_tail": F.lead("_tail", back).over(back_to)}
        | (extra or {})
    )
    whole = F.pmod(F.col("i") - back, F.lit(length)) == 0
    merged = F.when(whole, F.col("_tail")).otherwise(summary.merge(F.col("_tail"), F.col("_head")))
    return both.withColumn(name, merged).drop("_head", "_tail")


def growing(blocks: DataFrame, summary, skip: int, name: str, valid_from: Column, seen_from: Column) -> DataFrame:
    """Summary of rows ``[0, i-skip]`` at every row ``i``.

    ``valid_from``: first position of a block whose values are complete (rows
    before it lack their own lags). ``seen_from``: the same position for the
    *next* block, which splits each block's own rows into those the next block
    sees itself and those that must be carried into it.

    The blocks' summaries hold their last ``dt`` too. So both uses of the blocks
    read the same columns, and Spark shuffles them once.
    """
    usable = F.col("i") >= valid_from
    own = F.col("own")
    parts = blocks.groupBy(*BLOCK).agg(
        summary.aggregate(where=own).alias("_all"),
        summary.aggregate(where=own & (F.col("i") < seen_from)).alias("_left"),
        F.max("dt").alias("_until"),
    )
    order = Window.partitionBy("series_id").orderBy("block")
    parts = parts.withColumns(
        {
            "_pivot": F.first("_all").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_left": F.lag("_left").over(order),
        }
    )
    # all blocks but the previous one in full, then the unseen part of that one
    older = order.rowsBetween(Window.unboundedPreceding, -2)
    parts = parts.withColumn("_older", summary.running(F.col("_all"), older, F.col("_pivot")))
    carried = parts.select(
        *BLOCK,
        F.when(F.col("_left").isNotNull(), summary.merge(F.col("_older"), F.col("_left"))).alias("_carry"),
        "_until",
    )
    so_far = in_block().rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn("_run", summary.aggregate(so_far, where=usable))
    dated = F.col("dt").isNull() | F.col("_until").isNotNull()
    joined = local.join(carried.hint("merge"), list(BLOCK)).where(dated).drop("_until")
    total = F.when(F.col("_carry").isNotNull(), summary.merge(F.col("_carry"), F.col("_run"))).otherwise(F.col("_run"))
    joined = joined.withColumn("_total", total)
    if skip:
        joined = joined.withColumn("_total", F.lag("_total", skip).over(in_block()))
    return joined.withColumn(name, F.col("_total")).drop("_run", "_carry", "_total")

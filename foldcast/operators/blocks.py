"""Blocks: bounded runs of rows that carry the rows they need to look back at.

A series of any length is cut into blocks of ``block_rows`` positions, and each
block also receives the ``halo`` positions before it. Lags and sliding frames
computed inside a block are then equal to those over the whole series, and no
task ever holds more than ``block_rows + halo`` rows of one series. What looks
back without limit is carried in by ``carry_over`` (one summary row per block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
BLOCK = ("series_id", "block")


def to_blocks(
    rows: DataFrame, halo: int = 0, block_rows: int = BLOCK_ROWS, ahead: int = 0, segment: int = 1
) -> DataFrame:
    """Add ``block``, ``own`` and ``seg``; halo rows appear with ``own = false``.

    ``ahead`` copies the rows after a block too (for leads). ``seg`` cuts the
    positions into runs of ``segment`` rows for the sliding frames.
    """
    size = max(block_rows, halo, ahead, 1)
    last_block = F.floor((F.col("n") - 1) / size)
    home = F.floor(F.col("i") / size)
    first = F.greatest(F.floor((F.col("i") - ahead) / size), F.lit(0))
    last = F.least(F.floor((F.col("i") + halo) / size), last_block)
    return (
        rows.where((F.col("i") >= -halo) & (F.col("n") > 0))
        .withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("own", (F.col("i") >= 0) & (home == F.col("block")))
        .withColumn("seg", F.floor(F.col("i") / segment))
    )


def in_block() -> WindowSpec:
    """Time order inside a block; shares its sort with the segment frames."""
    return Window.partitionBy(*BLOCK).orderBy("seg", "i")


def latest_first() -> WindowSpec:
    """Latest row first inside a block; ``lead(c, k)`` there looks k rows back."""
    return Window.partitionBy(*BLOCK).orderBy("_nseg", F.col("i").desc())


def carry_over(parts: DataFrame, build) -> DataFrame:
    """Per block, what ``build(frame)`` gives over the earlier blocks of its series.

    ``parts`` has one row per ``(series_id, block)``; ``build`` maps a frame to
    a dict of columns.
    """
    earlier = (
        Window.partitionBy("series_id")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return parts.select(*BLOCK, *[c.alias(name) for name, c in build(earlier).items()])


def running_totals(blocks: DataFrame, totals: dict[str, Column], check: Column | None = None) -> DataFrame:
    """Running sums over the whole series in position order, two levels.

    ``blocks`` must hold own rows only. ``totals`` maps new names to the
    expression summed.
    """
    named = blocks.withColumns({f"_in_{k}": F.coalesce(c, F.lit(0).cast("double")) for k, c in totals.items()})
    parts = named.groupBy(*BLOCK).agg(*[F.sum(f"_in_{k}").alias(f"_part_{k}") for k in totals])
    carried = carry_over(
        parts,
        lambda frame: {
            f"_carry_{k}": F.coalesce(F.sum(f"_part_{k}").over(frame), F.lit(0.0)) for k in totals
        },
    )
    so_far = in_block().rowsBetween(Window.unboundedPreceding, 0)
    local = named.withColumns({f"_run_{k}": F.sum(f"_in_{k}").over(so_far) for k in totals})
    joined = local.join(carried.hint("merge"), list(BLOCK))
    out = joined.withColumns({k: F.col(f"_run_{k}") + F.col(f"_carry_{k}") for k in totals})
    return out.drop(*[f"_{part}_{k}" for k in totals for part in ("in", "run", "carry")])


def spread(per_series: DataFrame, block_rows: int = BLOCK_ROWS, length: str = "n") -> DataFrame:
    """Repeat one row per series for each of its blocks.

    Joining on ``(series_id, block)`` instead of ``series_id`` keeps the rows of
    a long series spread over many tasks, whatever the size of either side.
    """
    last = F.floor((F.greatest(F.col(length), F.lit(1)) - 1) / max(block_rows, 1))
    return per_series.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))

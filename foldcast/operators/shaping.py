"""Fills, caps, returns and lag frames over whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcast.functions.values import fill_zero, growth, guard_infinity, input_return
from foldcast.operators.blocks import BLOCK_ROWS, in_block, to_blocks
from foldcast.operators.rows import number_rows


def forward_fill(prices: DataFrame, bucket_width: int | None = None) -> DataFrame:
    """Last known price carried forward; rows before the first one are dropped."""
    return number_rows(prices, bucket_width=bucket_width).select(*prices.columns)


def fill_missing(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.withColumns({c: fill_zero(F.col(c)) for c in columns})


def replace_infinite(table: DataFrame, columns: list[str], to: float = 0.0) -> DataFrame:
    return table.withColumns({c: guard_infinity(F.col(c), to) for c in columns})


def cap_dates(table: DataFrame, start=None, end=None) -> DataFrame:
    """Rows between two dates, both included."""
    if start is not None:
        table = table.where(F.col("dt") >= F.lit(start))
    if end is not None:
        table = table.where(F.col("dt") <= F.lit(end))
    return table


def returns(
    prices: DataFrame, periods: int = 1, as_input: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``ret``: price over the price ``periods`` rows earlier, minus 1.

    Missing prices are carried forward first. A return over a zero price is
    infinite: 0 for an input column, missing for a target.
    """
    blocks = to_blocks(number_rows(prices), halo=periods, block_rows=block_rows)
    rate = input_return if as_input else growth
    before = F.lag("price", periods).over(in_block())
    out = blocks.withColumn("ret", rate(F.col("price"), before)).where("own")
    return out.select(*prices.columns, "i", "n", "ret")


def lag_frame_columns(columns: list[str], n_in: int, n_out: int) -> dict[str, Column]:
    """Lags n_in..1, the row itself, then leads 1..n_out-1 of every column."""
    order = in_block()
    out: dict[str, Column] = {}
    for k in range(n_in, 0, -1):
        for j, c in enumerate(columns, 1):
            out[f"var{j}_lag{k}"] = F.lag(c, k).over(order)
    for k in range(n_out):
        for j, c in enumerate(columns, 1):
            name = f"var{j}" if k == 0 else f"var{j}_lead{k}"
            out[name] = F.col(c) if k == 0 else F.lead(c, k).over(order)
    return out


def supervised(
    table: DataFrame,
    columns: list[str],
    n_in: int = 1,
    n_out: int = 1,
    fill: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Supervised frame of a series: every row kept, its edges missing."""
    numbered = number_rows(table, values=tuple(columns), fill=fill)
    blocks = to_blocks(numbered, halo=n_in, ahead=max(n_out - 1, 0), block_rows=block_rows)
    framed = lag_frame_columns(columns, n_in, n_out)
    return blocks.withColumns(framed).where("own").select("series_id", "dt", "i", "n", *framed)


def horizon_pairs(table: DataFrame, column: str, horizon: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pair row i with the target ``horizon`` rows later."""
    blocks = to_blocks(
        number_rows(table, values=(column,), fill=False), ahead=horizon, block_rows=block_rows
    )
    later = F.lead(column, horizon).over(in_block())
    return blocks.withColumn("target", later).where("own").select(
        "series_id", "dt", "i", F.col(column).alias("x"), "target"
    )


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Column-wise union of two tables with equal keys."""
    return left.join(right, ["series_id", "dt"])

"""Blocks as packed rows, copied to the later blocks that look back on them.

Where a fold needs its rows themselves and not a summary of them, a block of
rows is packed into one row of arrays and copied once for every block of folds that
reaches it, not once for every fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.operators.blocks import BLOCK

#: Bytes of packed rows that one group may hold.
MOST_BYTES = 1 << 29


def pack(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per ``(series_id, block)``: ``first`` position, ``n``, and an array per column in position order.

    ``rows`` are blocked own rows, so the group has at most a block's rows and
    is where its rows already are.
    """
    each = F.sort_array(F.collect_list(F.struct("i", *columns))).alias("_rows")
    packed = rows.groupBy(*BLOCK).agg(F.max("n").alias("n"), each)
    return packed.select(*BLOCK, "n", F.col("_rows.i")[0].alias("first"), *[F.col("_rows")[c].alias(c) for c in columns])


def fan_out(packed: DataFrame, size: int, back: int | None) -> DataFrame:
    """Copy each packed block to its own block and those whose folds look up to ``back`` rows back; to all later ones with None.

    ``home`` is where the copied rows belong.
    """
    last = F.floor((F.col("n") - 1) / size)
    reach = last if back is None else F.least(last, F.floor(((F.col("home") + 1) * size - 1 + back) / size))
    return packed.withColumnRenamed("block", "home").withColumn("block", F.explode(F.sequence(F.col("home"), reach)))


class Run:
    """Rows ``first, first+1, ...`` of a series up to the end of one block; ``own`` is where the block begins."""

    def __init__(self, table: pa.Table, columns: list[str], most_bytes: int) -> None:
        if table.nbytes > most_bytes:
            raise ValueError(f"{table.nbytes} bytes of rows for one block of folds, more than {most_bytes}: take sliding windows, smaller blocks or a higher bound")
        order = np.argsort(table.column("home").to_numpy())
        self.series_id, self.block = table.column("series_id")[0], table.column("block")[0].as_py()
        self.n = table.column("n")[0].as_py()
        firsts = table.column("first").to_numpy()[order]
        self.first, self.own = int(firsts[0]), int(firsts[-1])
        self.data = {c: pa.concat_arrays([table.column(c)[k].values for k in order.tolist()]) for c in columns}

    def floats(self, column: str) -> np.ndarray:
        """Missing values are NaN."""
        return self.data[column].to_numpy(zero_copy_only=False).astype(np.float64)

    @property
    def end(self) -> int:
        return self.first + len(next(iter(self.data.values())))


def apply_blocks(copies: DataFrame, columns: list[str], function: Callable[[Run, dict], Iterator[pa.RecordBatch]], schema: str, extra: list[str] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """``function`` of every block's run of rows, and of the ``extra`` columns of its packed row, in Arrow."""

    def run(table: pa.Table) -> pa.Table:
        rows = Run(table, columns, most_bytes)
        home = table.column("home").to_numpy().argmax()
        return function(rows, {c: table.column(c)[int(home)].as_py() for c in extra})

    names = ["series_id", "block", "home", "n", "first", *columns, *extra]
    return copies.select(*names).groupBy(*BLOCK).applyInArrow(run, schema)

"""Chronological train / validation / test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _held_out(length: Column, share: float) -> Column:
    return F.ceil(length.cast("double") * F.lit(share))


def split_role(test_size: float = 0.1, validation_size: float = 0.15) -> Column:
    """Role of a numbered row: the last rows are test, those before them validation."""
    n, i = F.col("n"), F.col("i")
    kept = n - _held_out(n, test_size)
    train = kept - _held_out(kept, validation_size)
    return F.when(i >= kept, "test").when(i >= train, "validation").otherwise("train")


def chronological_split(numbered: DataFrame, test_size: float = 0.1, validation_size: float = 0.15) -> DataFrame:
    return numbered.withColumn("role", split_role(test_size, validation_size))

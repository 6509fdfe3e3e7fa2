"""Input contract: keys, equal indexes, series lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.operators.folds import FoldSpec


def repeated_keys(table: DataFrame) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return table.groupBy("series_id", "dt").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def key_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys present on one side only; empty when both tables have the same index."""
    a = left.select("series_id", "dt", F.lit(1).alias("in_left"))
    b = right.select("series_id", "dt", F.lit(1).alias("in_right"))
    joined = a.join(b, ["series_id", "dt"], "full_outer")
    return joined.where(F.col("in_left").isNull() | F.col("in_right").isNull())


def uneven_dates(table: DataFrame) -> DataFrame:
    """Dates on which some series have a row and others have none, with how many of each."""
    by_date = table.groupBy("dt").agg(F.count_distinct("series_id").alias("present"))
    total = table.agg(F.count_distinct("series_id").alias("series"))  # one row
    joined = by_date.join(total, by_date["present"] < total["series"])
    return joined.select("dt", "present", (F.col("series") - F.col("present")).alias("missing"))


def length_report(prices: DataFrame, spec: FoldSpec) -> DataFrame:
    """Rows per series, and whether the window fits into them."""
    counted = prices.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("price").alias("n_prices")
    )
    return counted.withColumn("fits", (F.col("n_rows") > spec.window_size).cast("bigint"))


def require(prices: DataFrame, spec: FoldSpec) -> None:
    """Raise on the first broken rule; runs two small aggregations."""
    bad = repeated_keys(prices).limit(1).collect()
    if bad:
        raise ValueError(f"repeated key: {bad[0]['series_id']} {bad[0]['dt']}")
    short = length_report(prices, spec).where("fits = 0").limit(1).collect()
    if short:
        raise ValueError(f"series {short[0]['series_id']} has {short[0]['n_rows']} rows, no more than window_size {spec.window_size}")

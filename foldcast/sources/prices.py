"""Price sources. Everything becomes ``(series_id STRING, dt, price DOUBLE)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.functions.values import nan_to_null, whole_day


def read_wide_csv(spark: SparkSession, path: str, instruments: list[str], header: bool = True) -> DataFrame:
    """CSV whose first column is the date and every other column one instrument: ``dt`` and ``instruments``.

    With a header, columns are picked by name, wherever they stand, and every file must have
    the same header; without one, ``instruments`` names the value columns in file order.
    Nothing is inferred, and a cell that is no number, or no date, fails the read.
    """
    columns = ["dt", *instruments]
    if header:
        columns = spark.read.csv(path, header=True).columns
        if missing := set(instruments) - set(columns[1:]):
            raise ValueError(f"no column {sorted(missing)} among {columns[1:]}")
    kinds = [T.DoubleType() if c in instruments and k else T.StringType() for k, c in enumerate(columns)]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(columns, kinds)])
    table = spark.read.schema(schema).csv(path, header=header, nanValue="NaN", enforceSchema=not header, mode="FAILFAST")
    return table.select(whole_day(F.col(f"`{columns[0]}`")).alias("dt"), *[F.col(f"`{c}`") for c in instruments])


def pick(wide: DataFrame, instrument: str) -> DataFrame:
    """One instrument of a wide table as a long one."""
    return wide.select(
        F.lit(instrument).alias("series_id"), "dt", nan_to_null(F.col(instrument)).alias("price")
    )


def to_long(wide: DataFrame, instruments: list[str]) -> DataFrame:
    """All named instruments of a wide table, one row per instrument and date."""
    long = wide.select("dt", *instruments).unpivot(["dt"], instruments, "series_id", "price")
    return long.select("series_id", "dt", nan_to_null(F.col("price")).alias("price"))


def to_wide(prices: DataFrame, instruments: list[str]) -> DataFrame:
    return prices.groupBy("dt").pivot("series_id", instruments).agg(F.first("price"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(c: str):
    # whole cents: the sum does not depend on the order of rows
    return F.round(F.col(c) * 100).cast("bigint")


def lineitem_prices(spark: SparkSession, folder: str, by: str) -> DataFrame:
    """Average price per unit and shipping day, one series per value of ``by``."""
    items = read_table(spark, folder, "lineitem")
    return (
        items.groupBy(F.col(by).cast("string").alias("series_id"), whole_day(F.col("l_shipdate")).alias("dt"))
        .agg(F.sum(_cents("l_extendedprice")).alias("cents"), F.sum("l_quantity").alias("units"))
        .select("series_id", "dt", F.try_divide(F.col("cents") / F.lit(100.0), F.col("units")).alias("price"))
    )


def order_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Order value per day, one series per order status."""
    orders = read_table(spark, folder, "orders")
    return (
        orders.groupBy(F.col("o_orderstatus").alias("series_id"), whole_day(F.col("o_orderdate")).alias("dt"))
        .agg(F.sum(_cents("o_totalprice")).alias("cents"))
        .select("series_id", "dt", (F.col("cents") / F.lit(100.0)).alias("price"))
    )


def event_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Mean event value per type and hour; hours from the first event of any type to the last are there, empty ones NULL."""
    events = read_table(spark, folder, "events").select("event_type", "ts", "value")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    seen = (
        events.groupBy(F.col("event_type").alias("series_id"), hour.alias("dt"))
        .agg(F.sum(_cents("value")).alias("cents"), F.count("value").alias("k"))
        .select("series_id", "dt", F.try_divide(F.col("cents") / F.lit(100.0), F.col("k")).alias("price"))
    )
    # one row: the types and both ends of the grid
    ends = events.agg(F.collect_set("event_type").alias("types"), F.min(hour).alias("first"), F.max(hour).alias("last"))
    grid = (
        ends.where("first IS NOT NULL")
        .withColumn("series_id", F.explode("types"))
        .select("series_id", F.explode(F.sequence("first", "last", F.expr("interval 1 hour"))).alias("dt"))
    )
    return grid.join(seen, ["series_id", "dt"], "left")

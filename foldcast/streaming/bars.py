"""Price bars of events that go on arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "series_id string, ts timestamp, value double"


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of Parquet files under ``path``, the files there now and those that appear later."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def closing_row(events: DataFrame, width: str, delay: str) -> DataFrame:
    """One row so late that the watermark passes every bar of ``events``; it has no series and makes no bar."""
    end = F.max("ts") + F.expr(f"interval {width}") + F.expr(f"interval {delay}") + F.expr("interval 1 second")
    return events.agg(end.alias("ts")).where("ts IS NOT NULL").select(F.lit(None).cast("string").alias("series_id"), "ts", F.lit(None).cast("double").alias("value"))


def bars(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Mean value of each series and tumbling window of ``events(series_id, ts, value)``: ``series_id, dt, price``.

    The state is one sum and count for every open window. A row that comes later than
    ``delay`` behind the newest one may be left out, as its bar may have been given
    already; rows within it count. Values are summed in whole cents, so that their
    order does not matter. Rows without a series are left out; they only move the watermark.
    """
    cents = F.round(F.col("value") * 100).cast("bigint")
    made = (
        events.withWatermark("ts", delay)
        .groupBy("series_id", F.window("ts", width))
        .agg(F.sum(cents).alias("cents"), F.count("value").alias("k"), F.count("series_id").alias("rows"))
    )
    price = F.try_divide(F.col("cents") / F.lit(100.0), F.col("k"))
    # a filter on the series itself would be moved below the watermark
    return made.where("rows > 0").select("series_id", F.col("window.start").alias("dt"), price.alias("price"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what can be computed from the files there now to Parquet files under ``path``, then stop.

    ``checkpoint`` holds offsets and state: the next call goes on where this one ended,
    and one that was broken off is repeated without doubling rows.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

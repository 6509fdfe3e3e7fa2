"""As-of joins without putting a series in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldcast.operators.rows import time_bucket


def attach_newest(rows: DataFrame, events: DataFrame, name: str, bucket_width: int | None = None) -> DataFrame:
    """Add to each of ``rows(series_id, dt, ...)`` the value ``name`` of the newest event at or before its time, NULL before the first.

    ``events`` is ``(series_id, dt, name)``; of several events at one time the greatest value
    counts. Rows and events of a series and time bucket meet in one task; what came
    before a bucket is carried over by one row a bucket.
    """
    kind = dict(rows.dtypes)["dt"]
    told = events.select("series_id", F.col("dt").cast(kind), F.col(name).alias("_event")).where(F.col("_event").isNotNull())
    both = rows.withColumn("_row", F.lit(1)).unionByName(told.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_bucket", time_bucket(rows, bucket_width))
    here = Window.partitionBy("series_id", "_bucket").orderBy("dt", "_row", "_event").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_event", ignorenulls=True).over(here)).where("_row = 1")
    newest = F.max(F.when(F.col("_event").isNotNull(), F.struct("dt", "_event")))
    parts = both.groupBy("series_id", "_bucket").agg(newest.alias("_newest"))
    earlier = Window.partitionBy("series_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("series_id", "_bucket", F.last("_newest", ignorenulls=True).over(earlier).alias("_before"))
    joined = seen.join(carried.hint("merge"), ["series_id", "_bucket"])
    return joined.select(*rows.columns, F.coalesce("_seen", F.col("_before._event")).alias(name))

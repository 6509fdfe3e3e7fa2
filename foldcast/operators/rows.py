"""Positions of rows inside their series, without putting a series in one task.

Every table is long: ``(series_id, dt, value columns)``. A row's position, the
forward fill and the date cap all look back over the whole series; here each is
done in two levels. Rows are grouped by ``(series_id, time bucket)``, a bucket
holds at most as many rows as it has distinct times, and one summary row per
bucket carries count and last known value over to the later buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcast.functions.values import nan_to_null

DAYS_PER_BUCKET = 4096
SECONDS_PER_BUCKET = 3_600


def time_bucket(df: DataFrame, width: int | None = None) -> Column:
    """Bucket of ``dt``: days for a DATE column, seconds for a timestamp."""
    kind = df.schema["dt"].dataType
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date("dt") / F.lit(width or DAYS_PER_BUCKET))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_seconds(F.col("dt").cast("timestamp")) / F.lit(width or SECONDS_PER_BUCKET))
    raise TypeError("dt must be a date or a timestamp")


def number_rows(
    table: DataFrame,
    values: tuple[str, ...] = ("price",),
    fill: bool = True,
    start=None,
    end=None,
    bucket_width: int | None = None,
) -> DataFrame:
    """Add ``i`` (position from 0) and ``n`` (length of the series).

    ``fill``: carry the last known value forward and drop the rows before the
    first one. ``start``/``end`` cap the dates, both included: ``i`` counts
    from the first capped row, ``n`` counts capped rows, earlier rows stay
    with a negative ``i`` so that lags can still reach them, and ``n_all``
    keeps the length before the cap. A repeated ``(series_id, dt)`` raises; rows
    without a series or a time have no position and are left out.
    """
    bucket = time_bucket(table, bucket_width)
    rows = table.withColumns({v: nan_to_null(F.col(v)) for v in values})
    # stated here so that both uses of these rows below share one exchange
    rows = rows.withColumn("_bucket", bucket).where(
        F.col("series_id").isNotNull() & F.col("_bucket").isNotNull()
    )

    here = Window.partitionBy("series_id", "_bucket").orderBy("dt")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    repeated = F.lag("dt").over(here) == F.col("dt")
    message = F.concat(F.lit("repeated time in series "), F.col("series_id").cast("string"))
    added = {
        "_r": F.when(repeated, F.raise_error(message).cast("int")).otherwise(
            F.row_number().over(here) - 1
        )
    }
    if fill:
        added |= {f"_f{k}": F.last(v, ignorenulls=True).over(so_far) for k, v in enumerate(values)}
    rows = rows.withColumns(added)

    before = F.lit(False) if start is None else F.col("dt") < F.lit(start)
    after = F.lit(False) if end is None else F.col("dt") > F.lit(end)
    summary = rows.groupBy("series_id", "_bucket").agg(
        F.max("_r").alias("_last"),
        F.count_if(before).alias("_early"),
        F.count_if(after).alias("_late"),
        *(
            [F.max_by(f"_f{k}", "dt").alias(f"_v{k}") for k in range(len(values))]
            + [F.count_if(F.col(f"_f{k}").isNull()).alias(f"_gap{k}") for k in range(len(values))]
            if fill
            else []
        ),
    )

    order = Window.partitionBy("series_id").orderBy("_bucket")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    series = Window.partitionBy("series_id")
    if fill:
        summary = summary.withColumns(
            {f"_c{k}": F.last(f"_v{k}", ignorenulls=True).over(earlier) for k in range(len(values))}
        )
        lead = [
            F.when(F.col(f"_c{k}").isNull(), F.col(f"_gap{k}")).otherwise(F.lit(0))
            for k in range(len(values))
        ]
        drop = F.greatest(*lead) if len(lead) > 1 else lead[0]
    else:
        drop = F.lit(0)
    summary = summary.withColumn("_drop", drop).withColumns(
        {
            "_keep": F.col("_last") + 1 - F.col("_drop"),
            "_pre": F.greatest(F.col("_early") - F.col("_drop"), F.lit(0)),
            "_post": F.least(F.col("_late"), F.col("_last") + 1 - F.col("_drop")),
        }
    )
    total, pre, post = (F.sum(c).over(series) for c in ("_keep", "_pre", "_post"))
    summary = summary.select(
        "series_id",
        "_bucket",
        *([f"_c{k}" for k in range(len(values))] if fill else []),
        (F.coalesce(F.sum("_keep").over(earlier), F.lit(0)) - F.col("_drop") - pre).alias("_offset"),
        (total - pre - post).alias("n"),
        total.alias("n_all"),
    )

    out = rows.join(summary.hint("merge"), ["series_id", "_bucket"])
    if fill:
        out = out.withColumns(
            {v: F.coalesce(F.col(f"_f{k}"), F.col(f"_c{k}")) for k, v in enumerate(values)}
        )
        for v in values:
            out = out.where(F.col(v).isNotNull())
    if end is not None:
        out = out.where(~after)
    out = out.withColumn("i", F.col("_offset") + F.col("_r"))
    return out.select(*table.columns, "i", "n", "n_all")

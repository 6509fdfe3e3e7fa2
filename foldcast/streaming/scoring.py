"""Forecasts of rows that go on arriving, from the newest stored fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcast.functions.regression import linear_score
from foldcast.sources.models import latest_fits


def score_stream(rows: DataFrame, models: DataFrame, inputs: list[str], model: str) -> DataFrame:
    """Forecast of every row of the stream ``rows(series_id, dt, inputs, y)`` by its series' newest fit in ``models``.

    ``models`` is a model table; it is read anew for every batch of the stream, so later
    fits serve later rows. A series without a stored fit gets a NULL forecast.
    """
    fits = latest_fits(models.select("series_id", "refit_t", "intercept", "coef")).select("series_id", "intercept", "coef")
    scored = rows.join(fits, "series_id", "left")
    return scored.select("series_id", "dt", F.lit(model).alias("model"), linear_score("coef", "intercept", inputs).alias("pred"), F.col("y").alias("true"))

"""The model table: fitted coefficients as ordinary rows.

``(model, run_id, series_id, refit_t, fit_dt, intercept, coef, n_train,
params)``, partitioned by model and run. A run only ever reads its own rows,
so fits of an earlier run over later dates cannot leak into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "model STRING, run_id STRING, series_id STRING, refit_t BIGINT, fit_dt DATE, intercept DOUBLE, "
    "coef ARRAY<DOUBLE>, n_train BIGINT, params MAP<STRING,STRING>"
)
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]


def as_model_table(fits: DataFrame, model: str, run_id: str, params: dict[str, str] | None = None) -> DataFrame:
    """Give fitted rows the full schema; columns a model does not have are NULL."""
    types = dict(field.split(" ", 1) for field in SCHEMA.split(", "))
    given = F.create_map(*[F.lit(x) for pair in (params or {}).items() for x in pair]) if params else F.lit(None)
    constant = {"model": F.lit(model), "run_id": F.lit(run_id), "params": given}
    return fits.select(
        *[
            (constant.get(c) if c in constant else F.col(c) if c in fits.columns else F.lit(None))
            .cast(types[c])
            .alias(c)
            for c in COLUMNS
        ]
    )


def save_models(table: DataFrame, path: str) -> None:
    """Append; rewriting a run replaces only that run's partition."""
    (
        table.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "run_id")
        .parquet(path)
    )


def load_models(spark: SparkSession, path: str, model: str, run_id: str) -> DataFrame:
    """All fits of one run; the filter prunes to its folder."""
    table = spark.read.schema(SCHEMA).parquet(path)
    return table.where((F.col("model") == model) & (F.col("run_id") == run_id)).select(*COLUMNS)


def latest_fits(table: DataFrame) -> DataFrame:
    """Newest fit of every series."""
    newest = F.max_by(F.struct(*[c for c in table.columns if c != "series_id"]), "refit_t")
    return table.groupBy("series_id").agg(newest.alias("fit")).select("series_id", "fit.*")

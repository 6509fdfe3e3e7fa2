"""Reading tables and writing intermediate ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.session import shared_dir

#: ``[\x20\x09-\x0D]``, the white space that the contracts name.
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared folder that the session names."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the rows of the tasks that
    ran there, not a second run of everything before, and both sides of a
    later join see the same rows.
    """
    path = scratch(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_each(df: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with one row, that of the smallest text, for each row of the written table ``repeated(keys)``. Only rows named there are shuffled by key."""
    if repeated.isEmpty():
        return df
    rows = df.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*df.columns), text_or_empty()).alias("row"))
    return df.join(repeated, keys, "left_anti").unionByName(rows.select("row.*"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)

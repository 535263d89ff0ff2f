"""Keep-first, keep-last and key-attachment building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in the given order.

    Spark keeps one row per key and map task before the exchange (window group limit), so
    a key with any number of copies does not pile up in one task.
    """
    ranking = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranking)).where("_rank = 1").drop("_rank")


def last_per_key(df: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    return keep_by(df, key, F.col(ordinal).desc_nulls_last())


def first_per_key(df: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    return keep_by(df, key, F.col(ordinal).asc_nulls_last())

"""Tables laid out by symbol, so that what works per symbol needs no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tickersieve.operators.bar_state import daily_bars
from tickersieve.sources.store import new_path


def write_by_symbol(df: DataFrame, name: str, buckets: int, *order: str) -> DataFrame:
    """A table in `buckets` buckets of symbols, each a single file sorted by symbol and `order`; returns it.

    The table is kept under the shared folder; the name gets a suffix of its own, so that a version that is
    being read is never replaced."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, "symbol")
    dealt.write.format("parquet").bucketBy(buckets, "symbol").sortBy("symbol", *order).option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def write_bars(bars: DataFrame, name: str, buckets: int) -> DataFrame:
    """Clean bars, one per normal symbol and day, by symbol and date. bar_metrics reads it without an exchange."""
    return write_by_symbol(daily_bars(bars), name, buckets, "date")

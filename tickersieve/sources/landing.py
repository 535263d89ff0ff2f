"""A landing folder of the bulk feed with one partition per day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickersieve.functions.numbers import finite, truthy
from tickersieve.functions.symbols import normalize_symbol
from tickersieve.operators.feeds import bulk_rows
from tickersieve.sources.store import store


def land_bulk(responses: DataFrame, path: str) -> None:
    """Append `date, json` responses, each to its day's partition."""
    rows = responses.select(F.col("date").cast("date").alias("date"), "json")
    # one file per day and run; a set number of tasks, as small rows would else be written by one
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, "date").write.partitionBy("date").mode("append").parquet(path)


def recent_days(as_of: str | dt.date, days_back: int) -> list[dt.date]:
    """The weekdays among the last `days_back` days, newest first."""
    today = dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    days = (today - dt.timedelta(days=k) for k in range(days_back))
    return [d for d in days if d.weekday() < 5]


def bulk_day(spark: SparkSession, path: str, day: dt.date) -> DataFrame:
    """Quotes of one day. Only its own folder is listed and read, however many days have landed; a day without one is empty."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/date={day}")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    schema = "json string, date date"
    landed = spark.read.schema(schema).option("basePath", path).parquet(str(folder)) if there else spark.createDataFrame([], schema)
    return bulk_rows(landed)


def bulk_latest_partition(
    spark: SparkSession, path: str, wanted: DataFrame, as_of: str | dt.date, days_back: int = 9
) -> DataFrame:
    """As bulk_latest_date, over a landing folder. Days are tried backwards, each of them read
    and parsed once, and those before the first one that prices any wanted symbol not at all."""
    symbols = wanted.select(normalize_symbol(F.col("symbol")).alias("symbol"))
    usable = None
    for day in recent_days(as_of, days_back):
        price = finite(F.coalesce(F.col("close"), F.col("adj_close"), F.col("price")))
        quotes = bulk_day(spark, path, day).select(normalize_symbol(F.col("symbol")).alias("symbol"), price.alias("price"), "date")
        usable = store(quotes.where(truthy(F.col("price"))).join(symbols, "symbol", "left_semi"), "bulk-day")
        if not usable.isEmpty():
            break
    if usable is None:
        raise ValueError("no weekday in the given days")
    return usable

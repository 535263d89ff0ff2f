"""Finding columns by header name, whatever their case or spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_column(df: DataFrame, *names: str) -> str | None:
    """The column for the first alias that the header has; column order does not matter."""
    header: dict[str, str] = {}
    for column in df.columns:
        header.setdefault(column.strip().strip("\ufeff").lower(), column)
    return next((header[n.lower()] for n in names if n.lower() in header), None)


def column_or_null(df: DataFrame, *names: str) -> Column:
    found = find_column(df, *names)
    return F.lit(None).cast("string") if found is None else F.col(f"`{found}`")

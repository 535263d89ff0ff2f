"""Ticker spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickersieve.functions.numbers import strip


def normalize_symbol(symbol: Column) -> Column:
    """Display form: trimmed, upper case, dots for dashes; NULL is ''."""
    return F.translate(F.upper(strip(F.coalesce(symbol.cast("string"), F.lit("")))), "-", ".")


def to_api_symbol(symbol: Column) -> Column:
    """Data-vendor form: trimmed, upper case, dashes for dots."""
    return F.translate(F.upper(strip(F.coalesce(symbol.cast("string"), F.lit("")))), ".", "-")

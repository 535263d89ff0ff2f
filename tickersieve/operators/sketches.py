"""Approximate quantiles from sketches that are kept per file or day and merged later.

A sketch has a fixed size, whatever it has seen, so that medians over very many files need only their
sketches. Exact medians (`ranking`) stay the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 800  # values a sketch keeps per level; the rank error is below RANK_ERROR with 99 % confidence
RANK_ERROR = 0.01


def value_sketches(df: DataFrame, value: str, *keys: str, accuracy: int = ACCURACY) -> DataFrame:
    """keys and `sketch` of the values that are not NULL; without one, no row."""
    present = df.where(F.col(value).isNotNull())
    return present.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value), F.lit(accuracy)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketches: DataFrame, share: float, name: str = "median") -> DataFrame:
    """Each row's other columns, the number of values `n`, and the value at this share of the ranks."""
    others = [c for c in sketches.columns if c != "sketch"]
    n = F.kll_sketch_get_n_double("sketch")
    return sketches.select(*others, n.alias("n"), F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias(name))


def approximate_median(df: DataFrame, group: str, value: str, name: str = "median") -> DataFrame:
    """Per group with a value: n and the approximate median; map tasks send sketches only."""
    return quantile(value_sketches(df, value, group), 0.5, name)

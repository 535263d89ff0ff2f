"""Exact ranks and medians per group without collecting a group in one task.

A value's sort position is split in two levels of bins that are pure functions of the value:
`coarse` follows log2 of its magnitude (1024 bins per doubling) and `fine` cuts each coarse
bin in 65536. Equal values are first combined into counts, so copies cost nothing. Counting
then runs over three kinds of small groups: coarse bins of a group (20 thousand for values
under a million), fine bins of a coarse bin (at most 65536), and distinct values of a fine
bin, which agree to 8 digits. Adding the three gives the exact rank, however the values are
spread over the bins.

The counts feed several branches of one plan. They are the same exchange in each, which Spark
runs once; the rows below should be a stored table (see `store`), as plans above it are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE_PER_DOUBLING = 1024.0
FINE_PER_COARSE = 65536.0


def _bins(value: Column) -> tuple[Column, Column]:
    """Bins of a value; never NULL, which spares the joins on them a filter."""
    magnitude = F.log2(F.abs(value) + 1.0) * COARSE_PER_DOUBLING
    position = F.signum(value) * magnitude
    coarse = F.coalesce(F.floor(position), F.lit(0))
    fine = F.floor((position - coarse) * FINE_PER_COARSE).cast("int")
    return coarse, F.coalesce(fine, F.lit(0))


def value_counts(df: DataFrame, group: str, value: str, weight: str | None = None) -> DataFrame:
    """Rows (or summed weight) per group and distinct value, with the value's bins.

    Missing values are dropped after counting: a filter on the value itself would be pushed
    below whatever expression computes it and evaluate that twice.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    coarse, fine = _bins(F.col(value))
    return (
        df.groupBy(group, value)
        .agg(amount.alias("n"), F.count(value).alias("_present"))
        .where("_present > 0")
        .select(group, value, "n", coarse.alias("coarse"), fine.alias("fine"))
    )


class BinOffsets:
    """How many rows of a group lie below each of its bins.

    `coarse` holds one row per coarse bin with the group's row count (`total`) and the sums of
    the given conditions over the group; `fine` one row per fine bin.
    """

    def __init__(self, counts: DataFrame, group: str, **sums: Column) -> None:
        self.group = group
        self.counts = counts
        amounts = {"bin_n": F.col("n"), **{k: F.when(v, F.col("n")) for k, v in sums.items()}}
        fine_bins = counts.groupBy(group, "coarse", "fine").agg(
            *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in amounts.items()]
        )
        below_fine = (
            Window.partitionBy(group, "coarse")
            .orderBy("fine")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        self.fine = fine_bins.select(
            group,
            "coarse",
            "fine",
            "bin_n",
            F.coalesce(F.sum("bin_n").over(below_fine), F.lit(0)).alias("fine_below"),
        )
        in_group = Window.partitionBy(group).orderBy("coarse")
        below = in_group.rowsBetween(Window.unboundedPreceding, -1)
        overall = in_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        self.coarse = (
            fine_bins.groupBy(group, "coarse")
            .agg(*[F.sum(k).alias(k) for k in amounts])
            .select(
                group,
                "coarse",
                F.coalesce(F.sum("bin_n").over(below), F.lit(0)).alias("coarse_below"),
                F.sum("bin_n").over(overall).alias("total"),
                *[F.sum(k).over(overall).alias(k) for k in sums],
            )
        )

    def bins(self, coarse: DataFrame | None = None) -> DataFrame:
        """All fine bins with `below` and the columns of their coarse bin."""
        joined = self.fine.join(self.coarse if coarse is None else coarse, [self.group, "coarse"])
        below = F.col("coarse_below") + F.col("fine_below")
        return joined.withColumn("below", below).drop("coarse_below", "fine_below")

    def ranked(self, bins: DataFrame, value: str) -> DataFrame:
        """Distinct values of the given bins with `upto`, the rows at or below them."""
        key = [self.group, "coarse", "fine"]
        within = (
            Window.partitionBy(*key)
            .orderBy(value)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        upto = F.col("below") + F.sum("n").over(within)
        return self.counts.join(bins, key).withColumn("upto", upto).drop(*key[1:], "bin_n", "below")

    def medians(self, value: str, name: str = "median") -> DataFrame:
        """Exact median per group; only the one or two bins that hold it are sorted."""
        low_rank, high_rank = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
        holding = self.bins().where(
            (F.col("below") < high_rank) & (F.col("below") + F.col("bin_n") >= low_rank)
        )
        before = F.col("upto") - F.col("n")

        def at(rank: Column) -> Column:
            return F.max(F.when((before < rank) & (F.col("upto") >= rank), F.col(value)))

        ranked = self.ranked(holding, value)
        return ranked.groupBy(self.group).agg(((at(low_rank) + at(high_rank)) / 2.0).alias(name))


def median_of(df: DataFrame, group: str, value: str, name: str = "median") -> DataFrame:
    return BinOffsets(value_counts(df, group, value), group).medians(value, name)


def attach_per_value(rows: DataFrame, ranks: DataFrame, group: str, value: str, spread: str) -> DataFrame:
    """Left join `ranks` (one row per group and value) onto rows, which may repeat a value.

    Both sides are shuffled by the join itself, so that adaptive execution splits a value that
    very many rows share. Rows without a value get keys that match nothing and spread evenly.
    """
    keyed = rows.withColumns(
        {
            "_key": F.coalesce(F.col(value), F.lit(0.0)),
            "_salt": F.when(F.col(value).isNull(), -1 - F.pmod(F.hash(spread), F.lit(1_000_000))).otherwise(0),
        }
    )
    right = ranks.withColumnRenamed(value, "_key").withColumn("_salt", F.lit(0))
    return keyed.join(right, [group, "_key", "_salt"], "left").drop("_key", "_salt")

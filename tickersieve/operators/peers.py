"""Where a stock's price/earnings ratio stands among its peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersieve.functions.valuation import current_pe
from tickersieve.operators.ranking import BinOffsets, attach_per_value, value_counts

# Peers outside this open interval do not count for the percentile.
PERCENTILE_RANGE = (0.0, 500.0)
MIN_PEERS = 3


def with_peer_stats(
    stocks: DataFrame,
    peers: DataFrame | None = None,
    peer_by: str | None = None,
) -> DataFrame:
    """Add `current_pe`, `median_pe` and `pe_percentile`.

    `peers` are the rows compared with (default: the stocks themselves), `peer_by` the column
    whose value a stock shares with its peers (default: all peers are one group).

    The median counts every ratio; the percentile is the share of peers within
    PERCENTILE_RANGE at or below the stock's own ratio, which itself may lie outside.
    """
    group: Column = F.lit("all") if peer_by is None else F.coalesce(F.col(peer_by), F.lit(""))
    ratio = current_pe(F.col("price"), F.col("forward_eps"))
    rows = stocks.withColumn("current_pe", ratio).withColumn("_peer", group)
    if peers is None:
        counts = value_counts(rows, "_peer", "current_pe")
    else:
        # Own ratios join with weight 0, so that each one finds its place among the peers.
        compared = peers.select(group.alias("_peer"), ratio.alias("current_pe"), F.lit(1).alias("w"))
        own = rows.select("_peer", "current_pe", F.lit(0).alias("w"))
        counts = value_counts(compared.unionByName(own), "_peer", "current_pe", "w")

    low, high = PERCENTILE_RANGE
    pe = F.col("current_pe")
    offsets = BinOffsets(
        counts, "_peer", eligible=(pe > low) & (pe < high), too_low=pe <= low
    )
    # The median joins the table of coarse bins, the smallest one that reaches every value. For
    # one group of all peers it is a scalar: a join on a constant would lose its key.
    medians = offsets.medians("current_pe", "median_pe")
    if peer_by is None:
        only = medians.agg(F.max("median_pe").alias("median_pe")).scalar()
        coarse = offsets.coarse.withColumn("median_pe", only)
    else:
        coarse = offsets.coarse.join(medians, "_peer", "left")
    at_or_below = (
        F.when(pe <= low, F.lit(0))
        .when(pe >= high, F.col("eligible"))
        .otherwise(F.col("upto") - F.col("too_low"))
    )
    ranks = offsets.ranked(offsets.bins(coarse), "current_pe").select(
        "_peer",
        "current_pe",
        "median_pe",
        F.when(F.col("eligible") >= MIN_PEERS, at_or_below / F.col("eligible")).alias(
            "pe_percentile"
        ),
    )
    return attach_per_value(rows, ranks, "_peer", "current_pe", "symbol").drop("_peer")


def in_peer_sets(stocks: DataFrame, sets: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Each stock once for every peer set it belongs to, with `peer_set` and `peer`.

    `sets` has for each name who belongs to it and the column whose value a stock shares with its
    peers there. Figures of all sets then follow from one ranking by `peer`."""
    members = [
        F.when(F.coalesce(belongs, F.lit(False)), F.struct(F.lit(name).alias("peer_set"), F.concat(F.lit(f"{name}:"), F.coalesce(by, F.lit(""))).alias("peer")))
        for name, (belongs, by) in sets.items()
    ]
    return stocks.select("*", F.inline(F.array_compact(F.array(*members))))

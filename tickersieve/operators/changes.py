"""What changed between two versions of a table, and rescoring only what it touches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersieve.config import ScreenConfig
from tickersieve.functions.valuation import current_pe
from tickersieve.operators.score import score


def _hashed(df: DataFrame, key: str, side: str) -> DataFrame:
    columns = [c for c in sorted(df.columns) if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    # Two hashes of 64 bits with different seeds; equal rows have both in common.
    return df.select(key, F.xxhash64(F.lit(1), row).alias(f"{side}_1"), F.xxhash64(F.lit(2), row).alias(f"{side}_2"))


def row_changes(old: DataFrame, new: DataFrame, key: str = "symbol") -> DataFrame:
    """key and `change` (inserted, deleted, changed, unchanged) of rows that are unique by key.

    Rows meet as hashes; no other column is shuffled. Both tables need the same columns."""
    joined = _hashed(old, key, "old").join(_hashed(new, key, "new"), key, "full_outer")
    same = (F.col("old_1") == F.col("new_1")) & (F.col("old_2") == F.col("new_2"))
    change = (
        F.when(F.col("old_1").isNull(), "inserted").when(F.col("new_1").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    )
    return joined.select(key, change.alias("change"))


def moved_groups(old: DataFrame, new: DataFrame, changes: DataFrame, group: str = "sector") -> DataFrame:
    """Groups whose peer figures may move: a member came, went, or has another ratio or group."""
    touched = changes.where("change != 'unchanged'").select("symbol")
    ratio = current_pe(F.col("price"), F.col("forward_eps"))
    own = lambda df, side: df.join(touched, "symbol", "left_semi").select("symbol", F.coalesce(group, F.lit("")).alias(f"{side}_group"), ratio.alias(f"{side}_pe"))
    pairs = own(old, "old").join(own(new, "new"), "symbol", "full_outer")
    moved = pairs.where("not (old_pe <=> new_pe) or not (old_group <=> new_group)")
    return moved.select(F.explode(F.array_compact(F.array("old_group", "new_group"))).alias("group")).distinct()


def rescored(
    old_scores: DataFrame, old: DataFrame, new: DataFrame, cfg: ScreenConfig, as_of: str | dt.date, group: str = "sector"
) -> DataFrame:
    """The scores of `new` among its own group's peers: those of groups that moved and of changed rows are worked
    out, the others are taken from `old_scores`, the scores of `old`."""
    changes = row_changes(old, new)
    moved = moved_groups(old, new, changes, group)
    key = F.coalesce(group, F.lit(""))
    keyed = new.withColumn("_group", key)
    in_moved = keyed.join(moved, keyed["_group"] == moved["group"], "left_semi")
    still = keyed.join(moved, keyed["_group"] == moved["group"], "left_anti")
    changed = still.join(changes.where("change = 'changed'"), "symbol", "left_semi")
    peers = still.join(changed.select("_group").distinct(), "_group", "left_semi")
    kept = still.select("symbol").join(changes.where("change = 'unchanged'"), "symbol", "left_semi")
    whole = score(in_moved.drop("_group"), cfg, as_of, peer_by=group)
    single = score(changed.drop("_group"), cfg, as_of, peers=peers.drop("_group"), peer_by=group)
    columns = old_scores.columns
    return old_scores.join(kept, "symbol", "left_semi").unionByName(whole.select(columns)).unionByName(single.select(columns))

"""The two snapshot jobs and the screen's stock table, from landed inputs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from tickersieve.config import ScreenConfig
from tickersieve.operators.bars import eod_metrics, within_history
from tickersieve.operators.feeds import info_to_fundamentals
from tickersieve.operators.snapshots import (
    apply_overrides,
    merge_fundamentals,
    merge_prices,
    resolve_fund_snapshot,
    resolve_price_snapshot,
)
from tickersieve.operators.universe import only_wanted, refresh_universe
from tickersieve.sources.files import require_rows, write_fundamentals, write_prices
from tickersieve.sources.store import store

# How much history the price job looks at.
HISTORY_MONTHS = 13


def price_job(
    bars: DataFrame,
    universe: DataFrame,
    path: str,
    updated_at: str,
    as_of: str | dt.date,
    months: int = HISTORY_MONTHS,
) -> None:
    """Bars of the universe to the price snapshot file; fails if nothing was priced.

    The metrics, one row per symbol, are written once before the check and the sort, which
    would both go through all bars again otherwise.
    """
    recent = within_history(bars, as_of, months)
    prices = store(eod_metrics(only_wanted(recent, universe), updated_at), "prices")
    write_prices(require_rows(prices, "prices"), path)


def fundamentals_job(records: DataFrame, path: str, updated_at: str) -> None:
    """Fundamentals records to the fundamentals snapshot file."""
    write_fundamentals(info_to_fundamentals(records, updated_at), path)


def build_stocks(
    constituents: DataFrame,
    shared: DataFrame,
    prices: DataFrame,
    fundamentals: DataFrame,
    cfg: ScreenConfig,
    overrides: DataFrame | None = None,
    old: DataFrame | None = None,
) -> DataFrame:
    """Universe with both snapshots and the user's edits merged on.

    Every step joins on symbol, one row per symbol on both sides, so the hash partitioning of
    the universe carries through all merges.
    """
    stocks = refresh_universe(constituents, shared, old)
    stocks = merge_prices(stocks, resolve_price_snapshot(prices, cfg))
    stocks = merge_fundamentals(stocks, resolve_fund_snapshot(fundamentals), cfg)
    return stocks if overrides is None else apply_overrides(stocks, overrides)

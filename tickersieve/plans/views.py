"""Screens over the stock table. Each is one lazy plan; lists are top-k, never full sorts."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickersieve.config import ALL, OVERVALUED, SECTOR_ORDER, ScreenConfig
from tickersieve.functions import scoring as S
from tickersieve.functions.symbols import normalize_symbol
from tickersieve.functions.text import matches_search, sector_label, status_label
from tickersieve.operators.peers import in_peer_sets
from tickersieve.operators.ranking import median_of
from tickersieve.operators.score import score
from tickersieve.operators.universe import is_watched
from tickersieve.sources.store import store

Day = str | dt.date
_MISSING_SORTS_AS = -999999.0


def in_sector(stocks: DataFrame, sector: str) -> DataFrame:
    return stocks if sector == ALL else stocks.where(F.col("sector") == sector)


def searched(stocks: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """The selected sector, restricted to rows that contain the search text."""
    rows = in_sector(stocks, cfg.selected_sector)
    if not cfg.search.strip():
        return rows
    columns = [F.col(c) for c in ("symbol", "name", "sector", "sub_industry")]
    return rows.where(matches_search(cfg.search, *columns))


def with_status(stocks: DataFrame, cfg: ScreenConfig, as_of: Day) -> DataFrame:
    """Searched rows with the wanted status.

    The status is judged among the searched rows, or within the selected sector if one is.
    """
    rows = searched(stocks, cfg)
    if cfg.status_filter == ALL:
        return rows
    peers = rows if cfg.selected_sector == ALL else in_sector(stocks, cfg.selected_sector)
    same = not cfg.search.strip() or cfg.selected_sector == ALL
    scored = score(rows, cfg, as_of, peers=None if same else peers)
    return scored.where(F.col("status") == cfg.status_filter).select(*stocks.columns)


def screen(stocks: DataFrame, cfg: ScreenConfig, as_of: Day) -> DataFrame:
    """Visible rows, scored among the whole universe or the selected sector.

    A status filter judges rows among the same peers, so that one scoring serves both, unless
    a search in the whole universe restricts the judging to the rows it finds.
    """
    rows = searched(stocks, cfg)
    no_search = not cfg.search.strip()
    peers = None if no_search else in_sector(stocks, cfg.selected_sector)
    if cfg.status_filter == ALL:
        return score(rows, cfg, as_of, peers=peers)
    if no_search or cfg.selected_sector != ALL:
        scored = score(rows, cfg, as_of, peers=peers)
        return scored.where(F.col("status") == cfg.status_filter)
    wanted = store(with_status(stocks, cfg, as_of).select("symbol"), "status")
    return score(rows.join(wanted, "symbol", "left_semi"), cfg, as_of, peers=peers)


def peer_sets(cfg: ScreenConfig) -> dict[str, tuple[Column, Column]]:
    """Who is compared with whom in the views of one render: everyone, the selected sector, each
    in its own sector, the user's own stocks, and the rows that a search finds."""
    one = F.lit("")
    columns = [F.col(c) for c in ("symbol", "name", "sector", "sub_industry")]
    sector = F.lit(True) if cfg.selected_sector == ALL else F.col("sector") == cfg.selected_sector
    return {
        "all": (F.lit(True), one),
        "selected": (sector, one),
        "own_sector": (F.lit(True), F.col("sector")),
        "watchlist": (is_watched(), one),
        "search": (matches_search(cfg.search, *columns), one),
    }


def scored_for_views(stocks: DataFrame, cfg: ScreenConfig, as_of: Day) -> DataFrame:
    """Every stock scored in each peer set it belongs to: all views of a render read this one table.

    The sets are ranked together; `peer_set` tells them apart."""
    return score(in_peer_sets(stocks, peer_sets(cfg)), cfg, as_of, peer_by="peer").drop("peer")


def column_name(sort_key: str) -> str:
    """The column of a sort key such as `forwardEPS`."""
    if sort_key == "range52":
        return "range_position"
    return re.sub(r"(?<=[a-z0-9])([A-Z]+)", r"_\1", sort_key).lower()


def sort_columns(scored: DataFrame, cfg: ScreenConfig) -> list[Column]:
    """Order of the visible list: texts and dates by locale, missing numbers as a very low one,
    then input order for ties. Flags and nested values count as missing numbers."""
    name = column_name(cfg.sort_key)
    if name == "status_class":
        kind, value = T.StringType(), S.status_class(F.col("status"))
    elif name in scored.columns:
        kind, value = scored.schema[name].dataType, F.col(name)
    else:
        raise ValueError(f"no column to sort by: {cfg.sort_key}")
    if isinstance(kind, (T.StringType, T.DateType)):
        key = F.collate(F.coalesce(value.cast("string"), F.lit("")), "UNICODE")
    elif isinstance(kind, T.NumericType):
        key = F.coalesce(value.cast("double"), F.lit(_MISSING_SORTS_AS))
    else:
        key = F.lit(_MISSING_SORTS_AS)
    return [key.desc() if cfg.sort_descending else key.asc(), F.col("ordinal").asc()]


def sorted_screen(stocks: DataFrame, cfg: ScreenConfig, as_of: Day) -> DataFrame:
    scored = screen(stocks, cfg, as_of)
    return scored.orderBy(*sort_columns(scored, cfg))


def best(scored: DataFrame, cfg: ScreenConfig, k: int) -> DataFrame:
    """Top rows by short score; ties in the order of the visible list."""
    return scored.orderBy(F.col("short_score").desc(), *sort_columns(scored, cfg)).limit(k)


def worst(scored: DataFrame, cfg: ScreenConfig, k: int) -> DataFrame:
    return scored.orderBy(F.col("short_score").asc(), *sort_columns(scored, cfg)).limit(k)


def is_flagged() -> Column:
    return F.col("value_trap") != ""


def is_risky() -> Column:
    return is_flagged() | F.coalesce(F.col("risk_score") >= 3.75, F.lit(False))


def reports_soon() -> Column:
    return F.coalesce(F.col("earnings_days").between(0, 14), F.lit(False))


def is_overvalued() -> Column:
    return F.col("status").isin(*OVERVALUED)


def sector_counts(stocks: DataFrame) -> DataFrame:
    """Stocks per sector: the total, the fixed sectors (also empty ones), then others A-Z."""
    spark = stocks.sparkSession
    names = [(ALL, 0)] + [(s, i + 1) for i, s in enumerate(SECTOR_ORDER)]
    fixed = spark.createDataFrame(names, "sector string, position int")
    counted = (
        stocks.groupBy("sector")
        .agg(F.count(F.lit(1)).alias("n"))
        .rollup("sector")
        .agg(F.sum("n").alias("n"), F.grouping("sector").alias("is_total"))
        .select(F.when(F.col("is_total") == 1, ALL).otherwise(F.col("sector")).alias("sector"), "n")
    )
    return (
        counted.join(fixed, "sector", "full")
        .select(
            "sector",
            sector_label(F.col("sector")).alias("label"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.coalesce("position", F.lit(len(names))).alias("position"),
        )
        .orderBy("position", "sector")
    )


_CARD = (
    "symbol",
    "name",
    "sector",
    "short_score",
    "upside",
    "peg",
    "range_position",
    "earnings_days",
    "return_h",
)


def graded(scored: DataFrame) -> list[Column]:
    return [
        S.grade(F.col(f"factor_{f}")).alias(f"grade_{f}")
        for f in ("value", "growth", "momentum", "quality", "risk")
    ]


def todays_picks(stocks: DataFrame, cfg: ScreenConfig, as_of: Day, k: int = 3) -> DataFrame:
    top = best(screen(stocks, cfg, as_of), cfg, k)
    return top.select(*_CARD, "reasons", *graded(top))


def sector_heatmap(stocks: DataFrame, cfg: ScreenConfig, as_of: Day, k: int = 8) -> DataFrame:
    """Best sectors by median score, each stock judged within its own sector."""
    named = stocks.where(F.coalesce(F.col("sector"), F.lit("")) != "")
    scored = store(
        score(named, cfg, as_of, peer_by="sector").select(
            "sector", "ordinal", "status", "short_score"
        ),
        "sector-scores",
    )
    shares = scored.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(is_overvalued(), 1.0).otherwise(0.0)).alias("overvalued_share"),
        F.min("ordinal").alias("first_seen"),
    )
    middle = median_of(scored, "sector", "short_score", "score")
    return (
        shares.join(middle, "sector")
        .orderBy(F.col("score").desc(), "first_seen")
        .limit(k)
        .select("sector", sector_label(F.col("sector")).alias("label"), "n", "score", "overvalued_share")
    )


def signals(stocks: DataFrame, cfg: ScreenConfig, as_of: Day, k: int = 3) -> DataFrame:
    top = best(screen(stocks, cfg, as_of), cfg, k)
    return top.select(*_CARD, F.slice("reasons", 1, 3).alias("reasons"))


def earnings_alerts(stocks: DataFrame, cfg: ScreenConfig, as_of: Day, k: int = 6) -> DataFrame:
    scored = screen(stocks, cfg, as_of).where(reports_soon())
    soonest = scored.orderBy(F.col("earnings_days").asc(), *sort_columns(scored, cfg)).limit(k)
    return soonest.select(
        "symbol",
        "name",
        "next_earnings_date",
        "earnings_days",
        S.earnings_label(F.col("earnings_days")).alias("label"),
        "return_h",
        "short_score",
    )


def risk_alerts(stocks: DataFrame, cfg: ScreenConfig, as_of: Day, k: int = 4) -> DataFrame:
    scored = screen(stocks, cfg, as_of).where(is_risky())
    return worst(scored, cfg, k).select(
        "symbol",
        "name",
        "value_trap",
        "risk_score",
        S.risk_label(F.col("risk_score")).alias("risk_label"),
        "short_score",
    )


def compact_list(stocks: DataFrame, cfg: ScreenConfig, as_of: Day, k: int = 30) -> DataFrame:
    """Top rows with the number of visible ones."""
    scored = screen(stocks, cfg, as_of)
    if cfg.status_filter != ALL:
        # Counted from written scores; counting the plan would score a second time.
        scored = store(scored, "screen")
    counted = searched(stocks, cfg) if cfg.status_filter == ALL else scored
    visible = counted.agg(F.count(F.lit(1)).alias("visible")).scalar()
    return best(scored, cfg, k).select(
        visible.alias("visible"),
        "symbol",
        "name",
        "sector",
        "price",
        "short_score",
        "upside",
        "peg",
        "earnings_days",
        "range_position",
        "return_h",
    )


def screen_table(stocks: DataFrame, cfg: ScreenConfig, as_of: Day) -> DataFrame:
    """The full table, in the order of the sort key."""
    return sorted_screen(stocks, cfg, as_of).select(
        "symbol",
        "name",
        sector_label(F.col("sector")).alias("sector_label"),
        S.origin_tag(F.col("fundamental_manual"), F.col("fundamental_auto")).alias("origin"),
        "price",
        "range_position",
        "forward_eps",
        "eps_growth",
        "rev_growth",
        "gross_margin",
        "op_margin",
        "exit_pe",
        "discount_rate",
        "current_pe",
        "sector_premium",
        "required_growth",
        "growth_gap",
        "peg",
        "pe_percentile",
        "return_h",
        "bear_fv",
        "base_fv",
        "bull_fv",
        "upside",
        status_label(F.col("status")).alias("status_label"),
        "risk_score",
        S.risk_label(F.col("risk_score")).alias("risk_label"),
    )


def watchlist_top(stocks: DataFrame, cfg: ScreenConfig, as_of: Day, k: int = 10) -> DataFrame:
    """Best of the user's own stocks, judged among themselves; ties in input order."""
    watched = score(stocks.where(is_watched()), cfg, as_of)
    top = watched.orderBy(F.col("short_score").desc(), F.col("ordinal").asc()).limit(k)
    return top.select(
        "symbol", "name", "sector", "short_score", "range_position", "return_h", "upside", "earnings_days"
    )


def summary_cards(stocks: DataFrame, cfg: ScreenConfig, as_of: Day) -> DataFrame:
    """One row of figures over all visible stocks."""
    full = screen(stocks, cfg, as_of)
    order = [c for c in full.columns if c == column_name(cfg.sort_key)]
    figures_need = (
        "symbol",
        "ordinal",
        "current_pe",
        "upside",
        "status",
        "risk_score",
        "earnings_days",
        "short_score",
    )
    scored = store(full.select(*dict.fromkeys((*figures_need, *order))), "visible-scores")

    # Both medians from one ranking, with the figure's name as the group.
    values = ("current_pe", "upside")
    figure_rows = F.array(*[F.struct(F.lit(v).alias("figure"), F.col(v).alias("value")) for v in values])
    ranked = median_of(scored.select(F.inline(figure_rows)), "figure", "value")
    # An aggregate without groups has one row even if there is nothing to rank.
    medians = ranked.agg(
        F.struct(*[F.max(F.when(F.col("figure") == v, F.col("median"))).alias(v) for v in values]).alias("m")
    ).scalar()

    # One scalar per leader, so that each is worked out once.
    top = best(scored, cfg, 1).select(F.struct("symbol", "short_score")).scalar()
    watch = watchlist_top(stocks, cfg, as_of, 1).select(F.struct("symbol", "short_score")).scalar()
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    figures = scored.agg(
        F.count(F.lit(1)).alias("n"),
        share(is_overvalued()).alias("overvalued_share"),
        share(F.coalesce(F.col("risk_score") >= 3.75, F.lit(False))).alias("high_risk_share"),
        F.count_if(reports_soon()).alias("earnings_soon"),
    )
    return figures.select(
        "n",
        medians["current_pe"].alias("median_pe"),
        medians["upside"].alias("median_upside"),
        "overvalued_share",
        "high_risk_share",
        "earnings_soon",
        top["symbol"].alias("top_symbol"),
        top["short_score"].alias("top_score"),
        watch["symbol"].alias("watch_symbol"),
        watch["short_score"].alias("watch_score"),
    )


def stock_detail(stocks: DataFrame, symbol: str, cfg: ScreenConfig, as_of: Day) -> DataFrame:
    """Everything about one stock, judged within its own sector."""
    wanted = normalize_symbol(F.lit(symbol))
    chosen = stocks.where(F.col("symbol") == wanted)
    # `chosen` has at most one row, so its sector is a scalar and the filter reaches the scan.
    peers = stocks.where(F.col("sector") == chosen.select("sector").scalar())
    return score(chosen, cfg, as_of, peers=peers)


def extremes_top(stocks: DataFrame, cfg: ScreenConfig, as_of: Day, k: int = 8) -> DataFrame:
    return best(screen(stocks, cfg, as_of), cfg, k).select(*_CARD)


def extremes_traps(stocks: DataFrame, cfg: ScreenConfig, as_of: Day, k: int = 4) -> DataFrame:
    return worst(screen(stocks, cfg, as_of).where(is_flagged()), cfg, k).select(*_CARD, "value_trap")

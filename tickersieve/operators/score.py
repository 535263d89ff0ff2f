"""The scored table: every model column of every stock in one projection over its peers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersieve.config import ScreenConfig
from tickersieve.functions import scoring as S
from tickersieve.functions import valuation as V
from tickersieve.functions.dates import days_until
from tickersieve.operators.peers import with_peer_stats


def with_valuation(stocks: DataFrame, cfg: ScreenConfig, as_of: str | dt.date) -> DataFrame:
    """Columns that need no peers."""
    c = F.col
    years = cfg.horizon.years
    price, eps, exit_pe = c("price"), c("forward_eps"), c("exit_pe")
    growth, disc = c("growth"), c("discount")

    def fair(shift: float, multiple: float, discount_shift: float):
        return V.fair_value(eps, exit_pe, growth, disc, years, shift, multiple, discount_shift)

    return (
        stocks.withColumns(
            {
                "growth": V.growth_rate(c("eps_growth")),
                "discount": V.discount(c("discount_rate"), cfg),
                "return_h": V.momentum(
                    c("return1m"), c("return3m"), c("return4m"), c("return6m"), cfg.horizon
                ),
                "risk_score": V.risk_score(c("risk"), cfg),
                "confidence": V.confidence(
                    price,
                    eps,
                    c("eps_growth"),
                    c("rev_growth"),
                    c("gross_margin"),
                    c("op_margin"),
                    exit_pe,
                    c("fundamental_auto"),
                ),
                "range_position": V.range_position(c("range52"), price, c("high52"), c("low52")),
                "drawdown52_high": V.relative_to(price, c("high52")),
                "from52_low": V.relative_to(price, c("low52")),
                "earnings_days": days_until(c("next_earnings_date"), as_of),
            }
        )
        .withColumns(
            {
                "bear_fv": fair(cfg.bear_growth_shift, 0.80, 2.0),
                "base_fv": fair(0.0, 1.0, 0.0),
                "bull_fv": fair(cfg.bull_growth_shift, 1.20, -1.0),
                "required_growth": V.required_growth(price, eps, exit_pe, disc, years),
            }
        )
        .withColumns(
            {
                "upside": V.upside(c("base_fv"), price),
                "growth_gap": V.growth_gap(c("required_growth"), c("eps_growth")),
                "sensitivity": V.sensitivity(c("bear_fv"), c("base_fv"), c("bull_fv")),
            }
        )
    )


def with_scores(valued: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Columns that build on the peer statistics."""
    c = F.col
    return (
        valued.withColumns(
            {
                "sector_premium": V.sector_premium(c("current_pe"), c("median_pe")),
                "peg": V.peg(c("current_pe"), c("eps_growth")),
            }
        )
        .withColumns(
            {
                "status": V.status(
                    c("price"),
                    c("forward_eps"),
                    c("base_fv"),
                    c("upside"),
                    c("sector_premium"),
                    c("required_growth"),
                    c("growth"),
                    cfg,
                ),
                "score_upside": S.upside_score(c("upside")),
                "score_percentile": S.percentile_score(c("pe_percentile")),
                "score_peg": S.peg_score(c("peg")),
                "score_gap": S.gap_score(c("growth_gap")),
                "score_risk": S.risk_component(c("risk_score")),
                "score_momentum": S.momentum_score(c("return_h")),
                "factor_growth": S.growth_score(c("eps_growth"), c("rev_growth")),
                "factor_quality": S.quality_score(c("gross_margin"), c("op_margin")),
            }
        )
        .withColumns(
            {
                "short_score": S.short_score(
                    c("score_upside"),
                    c("score_percentile"),
                    c("score_peg"),
                    c("score_gap"),
                    c("score_risk"),
                    c("score_momentum"),
                    c("confidence"),
                    c("earnings_days"),
                    cfg.horizon,
                ),
                "value_trap": S.value_trap(
                    c("current_pe"),
                    c("eps_growth"),
                    c("rev_growth"),
                    c("risk_score"),
                    c("return_h"),
                    c("growth_gap"),
                ),
                "factor_value": S.value_score(
                    c("score_upside"), c("score_percentile"), c("score_peg")
                ),
                "factor_momentum": c("score_momentum"),
                "factor_risk": c("score_risk"),
                "reasons": S.reasons(
                    c("pe_percentile"),
                    c("growth_gap"),
                    c("peg"),
                    c("return_h"),
                    c("risk_score"),
                    c("upside"),
                    c("range_position"),
                    c("earnings_days"),
                ),
            }
        )
        .drop("growth", "discount")
    )


def score(
    stocks: DataFrame,
    cfg: ScreenConfig,
    as_of: str | dt.date,
    peers: DataFrame | None = None,
    peer_by: str | None = None,
) -> DataFrame:
    """Stocks with every derived column; see `with_peer_stats` for the peer set."""
    return with_scores(with_valuation(with_peer_stats(stocks, peers, peer_by), cfg, as_of), cfg)

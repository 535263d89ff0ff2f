"""Per-stock valuation, position and risk expressions. All ratios are fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickersieve.config import RISK_FIELDS, Horizon, ScreenConfig
from tickersieve.functions.numbers import clamp, clamp_or, positive, steps, truthy


def current_pe(price: Column, eps: Column) -> Column:
    return F.when(truthy(price) & positive(eps), price / eps)


def growth_rate(eps_growth: Column) -> Column:
    return F.coalesce(eps_growth, F.lit(0.0)) / 100.0


def discount(discount_rate: Column, cfg: ScreenConfig) -> Column:
    return F.coalesce(discount_rate, F.lit(float(cfg.default_discount))) / 100.0


def fair_value(
    eps: Column,
    exit_pe: Column,
    growth: Column,
    disc: Column,
    years: float,
    growth_shift: float = 0.0,
    pe_multiple: float = 1.0,
    discount_shift: float = 0.0,
) -> Column:
    """Grown earnings at the exit multiple, discounted back; shifts are in percent."""
    grown = F.greatest(F.lit(-0.95), growth + growth_shift / 100.0)
    discounted = F.greatest(F.lit(0.0), disc + discount_shift / 100.0)
    value = (
        eps
        * F.pow(1.0 + grown, F.lit(years))
        * (exit_pe * pe_multiple)
        / F.pow(1.0 + discounted, F.lit(years))
    )
    return F.when(positive(eps) & positive(exit_pe), value)


def upside(fair: Column, price: Column) -> Column:
    return F.when(truthy(fair) & truthy(price), fair / price - 1.0)


def required_growth(
    price: Column, eps: Column, exit_pe: Column, disc: Column, years: float
) -> Column:
    """Yearly earnings growth that today's price needs."""
    target = price * F.pow(1.0 + disc, F.lit(years)) / (eps * exit_pe)
    usable = positive(price) & positive(eps) & positive(exit_pe) & (disc > -1.0)
    return F.when(usable, F.pow(target, F.lit(1.0 / years)) - 1.0)


def sector_premium(pe: Column, median_pe: Column) -> Column:
    return F.when(truthy(pe) & truthy(median_pe), pe / median_pe - 1.0)


def peg(pe: Column, eps_growth: Column) -> Column:
    return F.when(truthy(pe) & (eps_growth > 3.0), pe / eps_growth)


def growth_gap(required: Column, eps_growth: Column) -> Column:
    return required - eps_growth / 100.0


def sensitivity(bear: Column, base: Column, bull: Column) -> Column:
    return F.when(truthy(bear) & truthy(base) & truthy(bull), (bull - bear) / base)


def range_position(range52: Column, price: Column, high: Column, low: Column) -> Column:
    """Stored 52-week position, else derived from the range."""
    derivable = truthy(price) & truthy(high) & truthy(low) & (high > low)
    return F.coalesce(range52, F.when(derivable, clamp((price - low) / (high - low), 0, 1)))


def relative_to(price: Column, reference: Column) -> Column:
    return F.when(truthy(price) & truthy(reference), price / reference - 1.0)


def momentum(
    return1m: Column, return3m: Column, return4m: Column, return6m: Column, horizon: Horizon
) -> Column:
    longest = return4m if horizon.years < 0.8 else return6m
    return F.coalesce(longest, return3m, return1m)


def risk_score(risk: Column, cfg: ScreenConfig) -> Column:
    """Weighted mean of the sub-scores that are present and carry weight."""
    weights = {r: getattr(cfg.weights, r) or 0.0 for r in RISK_FIELDS}
    used = {r: float(w) for r, w in weights.items() if w > 0}
    if not used:
        return F.lit(None).cast("double")
    total = sum(
        (F.when(risk[r].isNotNull(), clamp_or(risk[r], 1, 1, 5) * w).otherwise(0.0))
        for r, w in used.items()
    )
    weight = sum((F.when(risk[r].isNotNull(), w).otherwise(0.0)) for r, w in used.items())
    return F.try_divide(total, weight)


def status(
    price: Column,
    eps: Column,
    base: Column,
    up: Column,
    premium: Column,
    required: Column,
    growth: Column,
    cfg: ScreenConfig,
) -> Column:
    valued = truthy(price) & positive(eps) & truthy(base)
    stretched = F.coalesce((premium > 0.30) & (required > growth + 0.04), F.lit(False))
    okay = F.when(stretched, "Overvalued").otherwise("Okay")
    return (
        F.when(~valued, "Need EPS")
        .when(up >= 0.25, "Very undervalued")
        .when(up >= 0.10, "Undervalued")
        .when(up >= cfg.overvalued_threshold / 100.0, okay)
        .when(up >= -0.25, "Overvalued")
        .otherwise("Very overvalued")
    )


def confidence(
    price: Column,
    eps: Column,
    eps_growth: Column,
    rev_growth: Column,
    gross_margin: Column,
    op_margin: Column,
    exit_pe: Column,
    auto: Column,
) -> Column:
    """Points for every input that is there, at most 100."""
    points = [
        (positive(price), 15.0),
        (positive(eps), 20.0),
        (eps_growth.isNotNull(), 15.0),
        (rev_growth.isNotNull(), 12.0),
        (gross_margin.isNotNull(), 8.0),
        (op_margin.isNotNull(), 10.0),
        (positive(exit_pe), 8.0),
        (F.coalesce(auto, F.lit(False)), 12.0),
    ]
    total = F.lit(0.0)
    for present, score in points:
        total = total + F.when(present, score).otherwise(0.0)
    return total


# Thresholds and sub-scores of the four risk ladders.
def balance_risk(debt_to_equity: Column) -> Column:
    x = debt_to_equity
    return steps(
        x, [(x >= 300, 4.7), (x >= 200, 4.2), (x >= 120, 3.5), (x >= 70, 2.8), (x >= 30, 2.2)], 1.7
    )


def crowding_risk(pe: Column) -> Column:
    x = F.when(pe > 0.0, pe)
    return steps(x, [(x >= 60, 4.8), (x >= 40, 4.2), (x >= 28, 3.5), (x >= 18, 2.7)], 2.0)


def cyclical_risk(beta: Column) -> Column:
    return clamp(F.when(beta > 0.0, 1.5 + beta * 1.2), 1, 5)


def margin_risk(op_margin: Column) -> Column:
    x = op_margin
    return steps(x, [(x < 5, 4.7), (x < 12, 4.0), (x < 20, 3.2), (x < 30, 2.5)], 1.9)

"""Component scores, factor grades, reasons and display buckets."""

# The thresholds, steps and texts in this module are fixed values of the screen.

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickersieve.config import DEFAULT_CHIP, HIGH_HOPES_TEXT, MISSING_TEXT, TRAP_TEXT, Horizon
from tickersieve.functions.numbers import clamp_or, steps


def upside_score(up: Column) -> Column:
    return clamp_or(50.0 + up * 140.0, 40)


def percentile_score(percentile: Column) -> Column:
    return clamp_or(100.0 - percentile * 100.0, 50)


def peg_score(ratio: Column) -> Column:
    x = ratio
    ladder = [(x < 1.2, 95.0), (x < 2.0, 78.0), (x < 2.8, 55.0), (x < 4.0, 32.0)]
    return F.coalesce(steps(x, ladder, 12.0), F.lit(45.0))


def gap_score(gap: Column) -> Column:
    x = gap
    ladder = [(x <= 0.0, 95.0), (x <= 0.03, 78.0), (x <= 0.06, 58.0), (x <= 0.10, 35.0)]
    return F.coalesce(steps(x, ladder, 12.0), F.lit(45.0))


def risk_component(risk: Column) -> Column:
    return clamp_or(100.0 - (risk - 1.0) / 4.0 * 100.0, 55)


def momentum_score(mom: Column) -> Column:
    return clamp_or(50.0 + mom * 120.0, 50)


def growth_score(eps_growth: Column, rev_growth: Column) -> Column:
    eps = clamp_or(50.0 + eps_growth * 3.0, 50)
    rev = clamp_or(50.0 + rev_growth * 3.5, 50)
    return eps * 0.6 + rev * 0.4


def quality_score(gross_margin: Column, op_margin: Column) -> Column:
    gross = clamp_or(gross_margin * 1.3, 50)
    operating = clamp_or(40.0 + op_margin * 1.6, 50)
    return gross * 0.45 + operating * 0.55


def value_score(s_upside: Column, s_percentile: Column, s_peg: Column) -> Column:
    return s_upside * 0.35 + s_percentile * 0.35 + s_peg * 0.30


def short_score(
    s_upside: Column,
    s_percentile: Column,
    s_peg: Column,
    s_gap: Column,
    s_risk: Column,
    s_momentum: Column,
    confidence: Column,
    earnings_days: Column,
    horizon: Horizon,
) -> Column:
    """Weighted score scaled by data confidence, less 4 points right before earnings."""
    blended = (
        s_upside * horizon.upside
        + s_percentile * horizon.percentile
        + s_peg * horizon.peg
        + s_gap * horizon.gap
        + s_risk * horizon.risk
        + s_momentum * horizon.momentum
    )
    trust = F.coalesce(0.72 + confidence / 360.0, F.lit(0.86))
    imminent = F.coalesce(earnings_days.between(0, 7), F.lit(False))
    haircut = F.when(imminent, 4.0).otherwise(0.0)
    # The scaled score lies within 0..100 already, as its parts do and trust is at most 1.
    return clamp_or(blended * trust - haircut, 0)


def value_trap(
    pe: Column, eps_growth: Column, rev_growth: Column, risk: Column, mom: Column, gap: Column
) -> Column:
    flags = F.lit(0)
    for sign in (pe < 15, eps_growth < 4, rev_growth < 3, risk >= 3.6, mom < -0.12):
        flags = flags + F.coalesce(sign.cast("int"), F.lit(0))
    return F.when(flags >= 3, TRAP_TEXT).when(gap > 0.08, HIGH_HOPES_TEXT).otherwise("")


def grade(score: Column) -> Column:
    x = score
    letters = steps(x, [(x >= 85, "A"), (x >= 70, "B"), (x >= 55, "C"), (x >= 40, "D")], "F")
    return F.coalesce(letters, F.lit(MISSING_TEXT))


def reasons(
    percentile: Column,
    gap: Column,
    ratio: Column,
    mom: Column,
    risk: Column,
    up: Column,
    range52: Column,
    earnings_days: Column,
) -> Column:
    """Up to four reason texts in a fixed order; a default one if none applies."""
    # Texts and thresholds of the reasons.
    tests = [
        (percentile < 0.35, "섹터 대비 저렴"),
        (gap <= 0.02, "성장률 부담 낮음"),
        (ratio < 1.8, "PEG 양호"),
        (mom > 0.03, "모멘텀 양호"),
        (risk < 2.8, "리스크 낮음"),
        (up > 0.1, "적정가 대비 여력"),
        (range52 < 0.35, "52주 저점권"),
        (earnings_days.between(0, 14), "실적 임박"),
    ]
    found = F.array_compact(F.array(*[F.when(test, text) for test, text in tests]))
    return F.when(F.size(found) == 0, F.array(F.lit(DEFAULT_CHIP))).otherwise(F.slice(found, 1, 4))


def score_class(score: Column) -> Column:
    return F.coalesce(
        steps(score, [(score >= 70, "good"), (score >= 50, "warn")], "bad"), F.lit("gray")
    )


def risk_class(risk: Column) -> Column:
    return F.coalesce(
        steps(risk, [(risk >= 3.75, "bad"), (risk >= 2.75, "warn")], "good"), F.lit("gray")
    )


def risk_label(risk: Column) -> Column:
    return F.coalesce(
        steps(risk, [(risk >= 3.75, "높음"), (risk >= 2.75, "중간")], "낮음"), F.lit(MISSING_TEXT)
    )


def status_class(status: Column) -> Column:
    return (
        F.when(status.isin("Very undervalued", "Undervalued"), "good")
        .when(status == "Okay", "warn")
        .when(status.isin("Overvalued", "Very overvalued"), "bad")
        .otherwise("gray")
    )


def range_label(position: Column) -> Column:
    x = position
    ladder = [(x < 0.20, "저점권"), (x < 0.45, "낮은 구간"), (x < 0.75, "중간"), (x < 0.92, "고점권")]
    return F.coalesce(steps(x, ladder, "52주 고점 근처"), F.lit(MISSING_TEXT))


def earnings_label(days: Column) -> Column:
    return (
        F.when(days < 0, "지남")
        .when(days == 0, "오늘")
        .when(days > 0, F.concat(days.cast("string"), F.lit("일 후")))
        .otherwise(MISSING_TEXT)
    )


def earnings_class(days: Column) -> Column:
    """A past date counts as 'warn', like anything up to two weeks ahead."""
    return F.when(days.between(0, 7), "bad").when(days <= 14, "warn").otherwise("gray")


def origin_tag(manual: Column, auto: Column) -> Column:
    return (
        F.when(F.coalesce(manual, F.lit(False)), "수동")
        .when(F.coalesce(auto, F.lit(False)), "자동")
        .otherwise("섹터기본")
    )

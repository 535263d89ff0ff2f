"""Step functions at, below and above their thresholds; parsing of odd cells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickersieve.config import RiskWeights, ScreenConfig
from tickersieve.functions import dates as D
from tickersieve.functions import numbers as N
from tickersieve.functions import scoring as S
from tickersieve.functions import text as X
from tickersieve.functions import valuation as V
from tickersieve.functions.symbols import normalize_symbol, to_api_symbol


def values(spark, expression, inputs, kind="double"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", expression(F.col("x"))).collect())]


STEPS = [
    (S.peg_score, [None, 1.19, 1.2, 1.99, 2.0, 2.79, 2.8, 3.99, 4.0, -1.0], [45, 95, 78, 78, 55, 55, 32, 32, 12, 95]),
    (S.gap_score, [None, -0.1, 0.0, 0.001, 0.03, 0.0301, 0.06, 0.0601, 0.1, 0.101], [45, 95, 95, 78, 78, 58, 58, 35, 35, 12]),
    (S.upside_score, [None, 0.0, 1.0, -1.0, 0.1], [40, 50, 100, 0, 64]),
    (S.percentile_score, [None, 0.0, 1.0, 0.25], [50, 100, 0, 75]),
    (S.risk_component, [None, 1.0, 5.0, 3.0], [55, 100, 0, 50]),
    (S.momentum_score, [None, 0.0, 1.0, -1.0], [50, 50, 100, 0]),
    (V.balance_risk, [None, 0.0, 29.9, 30.0, 69.9, 70.0, 119.9, 120.0, 199.9, 200.0, 299.9, 300.0, -5.0], [None, 1.7, 1.7, 2.2, 2.2, 2.8, 2.8, 3.5, 3.5, 4.2, 4.2, 4.7, 1.7]),
    (V.crowding_risk, [None, 0.0, -1.0, 17.9, 18.0, 27.9, 28.0, 39.9, 40.0, 59.9, 60.0], [None, None, None, 2.0, 2.7, 2.7, 3.5, 3.5, 4.2, 4.2, 4.8]),
    (V.cyclical_risk, [None, 0.0, -1.0, 0.5, 1.0, 10.0], [None, None, None, 2.1, 2.7, 5.0]),
    (V.margin_risk, [None, -1.0, 4.9, 5.0, 11.9, 12.0, 19.9, 20.0, 29.9, 30.0], [None, 4.7, 4.7, 4.0, 4.0, 3.2, 3.2, 2.5, 2.5, 1.9]),
    (S.grade, [None, 85.0, 84.9, 70.0, 69.9, 55.0, 54.9, 40.0, 39.9], ["–", "A", "B", "B", "C", "C", "D", "D", "F"]),
    (S.score_class, [None, 70.0, 69.9, 50.0, 49.9], ["gray", "good", "warn", "warn", "bad"]),
    (S.risk_class, [None, 3.75, 3.74, 2.75, 2.74], ["gray", "bad", "warn", "warn", "good"]),
    (S.risk_label, [None, 3.75, 3.74, 2.75, 2.74], ["–", "높음", "중간", "중간", "낮음"]),
    (S.range_label, [None, 0.19, 0.2, 0.449, 0.45, 0.749, 0.75, 0.919, 0.92], ["–", "저점권", "낮은 구간", "낮은 구간", "중간", "중간", "고점권", "고점권", "52주 고점 근처"]),
    (lambda x: N.clamp(x, 1, 5), [None, 0.0, 3.0, 9.0], [None, 1, 3, 5]),
    (N.truthy, [None, 0.0, -1.0, 2.0], [False, False, True, True]),
    (N.positive, [None, 0.0, -1.0, 2.0], [False, False, False, True]),
    (N.finite, [None, float("nan"), float("inf"), float("-inf"), 1.5], [None, None, None, None, 1.5]),
    (N.percent_points, [None, 1.5, 1.6, -1.5, -1.51, 0.0], [None, 150, 1.6, -150, -1.51, 0]),
]


@pytest.mark.parametrize("expression,inputs,wanted", STEPS, ids=range(len(STEPS)))
def test_steps(spark, expression, inputs, wanted):
    got = values(spark, expression, inputs)
    assert got == [pytest.approx(w) if isinstance(w, (int, float)) and not isinstance(w, bool) else w for w in wanted]


def test_earnings_buckets(spark):
    days = [None, -1, 0, 1, 7, 8, 14, 15]
    assert values(spark, S.earnings_label, days, "int") == ["–", "지남", "오늘", "1일 후", "7일 후", "8일 후", "14일 후", "15일 후"]
    assert values(spark, S.earnings_class, days, "int") == ["gray", "warn", "bad", "bad", "bad", "warn", "warn", "gray"]


def test_parsing(spark):
    texts = [None, "", "  ", " 3 ", "12%", "$3,000", "NaN", "Infinity", "1d", "12abc", "1e3", "-", ".5", "5.", "\t7 ", "1 2", "0x10"]
    loose = [None, None, None, 3, 12, 3000, None, None, None, None, 1000, None, 0.5, 5, 7, None, None]
    assert values(spark, N.parse_loose, texts, "string") == loose
    zero = [None, 0, 0, *loose[3:]]
    assert values(spark, lambda c: N.parse_loose(c, "zero"), texts, "string") == zero
    strict = [None, None, None, 3, None, None, None, None, None, None, 1000, None, 0.5, 5, 7, None, None]
    assert values(spark, N.parse_strict, texts, "string") == strict
    prefix = [None, None, None, 3, 12, None, None, None, 1, 12, 1000, None, 0.5, 5, 7, 1, 0]
    assert values(spark, N.parse_prefix, texts, "string") == prefix


def test_first_present(spark):
    df = spark.createDataFrame([(None, "", "0"), ("a", "b", "c"), (None, None, None)], "x string, y string, z string")
    got = [r[0] for r in df.select(N.first_present(*[F.col(c) for c in "xyz"])).collect()]
    assert got == ["0", "a", None]


def test_symbols(spark):
    texts = [None, " brk-b ", "BRK.B", "na"]
    assert values(spark, normalize_symbol, texts, "string") == ["", "BRK.B", "BRK.B", "NA"]
    assert values(spark, to_api_symbol, texts, "string") == ["", "BRK-B", "BRK-B", "NA"]


def test_dates(spark):
    seconds = [None, 0.0, -1.0, 1.0, 86399.0, 86400.0, 1004832000.0, 1e18, float("nan")]
    day = dt.date(1970, 1, 1)
    wanted = [None, None, None, day, day, dt.date(1970, 1, 2), dt.date(2001, 11, 4), None, None]
    assert values(spark, D.epoch_to_date, seconds) == wanted
    early = values(spark, lambda c: D.epoch_to_date(c, positive_only=False), [-1.0])
    assert early == [dt.date(1969, 12, 31)]
    texts = ["2001-11-14T00:00:00", "2001-10-31", "soon", "", None]
    until = lambda c: D.days_until(D.text_to_date(c), "2001-11-04")
    assert values(spark, until, texts, "string") == [10, -4, None, None, None]
    week = spark.range(1).select(D.recent_weekdays("2001-11-04", 10)).first()[0]
    assert week == [dt.date(2001, 11, d) for d in (2, 1)] + [dt.date(2001, 10, d) for d in (31, 30, 29, 26)]


def test_display(spark):
    ratio = [None, 0.145, 0.005, 0.125, -0.125, 12.345, float("nan"), 0.0]
    assert values(spark, lambda c: X.percent_text(c, 0), ratio) == ["–", "14%", "1%", "13%", "-13%", "1235%", "–", "0%"]
    assert values(spark, X.percent_text, [0.12345, 0.0025, 0.00125]) == ["12.3%", "0.3%", "0.1%"]
    assert values(spark, lambda c: X.number_text(c, 2), [None, 1234.5, 1.005, -0.5]) == ["–", "1,234.50", "1.01", "-0.50"]
    assert values(spark, X.money_text, [None, 1234.5]) == ["–", "$1,234.50"]


def test_labels(spark):
    assert values(spark, X.sector_label, ["All", "Energy", "Odd", "", None], "string") == ["전체", "에너지", "Odd", "기타", "기타"]
    assert values(spark, X.status_label, ["Okay", "Odd", None], "string") == ["적정", "Odd", None]


def test_search(spark):
    found = lambda q: values(spark, lambda c: X.matches_search(q, c, F.lit(None)), ["Red Ring", "bolt", None], "string")
    assert found(" RING ") == [True, False, False]
    assert found("") == [True, True, True]


@pytest.mark.parametrize("setting,years", [(0.33, 1 / 3), (0.79, 1 / 3), (0.8, 1), (1.9, 1), (2, 3), ("3", 3), (4, 5), ("x", 5), (-1, 1 / 3)])
def test_horizon(setting, years):
    profile = ScreenConfig(analysis_mode=setting).horizon
    assert profile.years == years
    assert sum((profile.upside, profile.percentile, profile.peg, profile.gap, profile.risk, profile.momentum)) == pytest.approx(1)


def test_config_merge():
    saved = {"default_discount": 9, "weights": {"cyc": 2.0, "odd": 1}, "unknown": 1}
    merged = ScreenConfig().merged_with(saved)
    assert merged.default_discount == 9 and merged.weights == RiskWeights(cyc=2.0)
    with pytest.raises(ValueError):
        ScreenConfig(blank_numeric="maybe")


def test_risk_score_skips_missing_parts(spark):
    df = spark.createDataFrame(
        [((9.0, None, None, None, None, None),), ((None,) * 6,), ((2.0, 4.0, None, None, None, None),)],
        "risk struct<rate:double,cyc:double,margin:double,balance:double,crowding:double,reg:double>",
    )
    got = [r[0] for r in df.select(V.risk_score(F.col("risk"), ScreenConfig())).collect()]
    assert got == [5.0, None, pytest.approx((2 + 4 * 1.1) / 2.1)]
    none = ScreenConfig(weights=RiskWeights(0, 0, 0, 0, -1, None))
    assert [r[0] for r in df.select(V.risk_score(F.col("risk"), none)).collect()] == [None] * 3

"""The scored table against a plain statement of the model on random stocks."""

import datetime as dt
import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tickersieve.config import RISK_FIELDS, RiskWeights, ScreenConfig
from tickersieve.operators.score import score
from tickersieve.schemas import STOCK_SCHEMA

AS_OF = dt.date(2001, 11, 4)


def make_stocks(n=250, seed=5):
    r = random.Random(seed)

    def maybe(value, share=0.15):
        return None if r.random() < share else value

    rows = []
    for i in range(n):
        eps = round(r.uniform(-2, 20), 2)
        fitting = round(abs(eps) * r.uniform(8, 60), 2)
        risk = tuple(maybe(round(r.uniform(0, 6), 2)) for _ in RISK_FIELDS)
        rows.append({
            "symbol": f"S{i:03d}", "name": f"Name {i}", "sector": r.choice(["Energy", "Utilities", "Odd"]),
            "sub_industry": "x", "ordinal": i, "price": maybe(r.choice([0.0, -4.0] + [fitting] * 20), 0.1),
            "price_source": "", "forward_eps": maybe(eps), "rev_growth": maybe(round(r.uniform(-10, 30), 2)),
            "eps_growth": maybe(round(r.uniform(-20, 40), 2)), "gross_margin": maybe(round(r.uniform(0, 90), 1)),
            "op_margin": maybe(round(r.uniform(-10, 40), 1)), "exit_pe": maybe(r.choice([0.0, 15.0, 25.0, 40.0])),
            "discount_rate": maybe(round(r.uniform(5, 13), 1)), "risk": risk, "notes": "", "fundamental_source": "",
            "fundamental_auto": r.random() < 0.5, "fundamental_manual": False, "risk_auto": False,
            "high52": maybe(round(r.uniform(100, 400), 2)), "low52": maybe(round(r.uniform(1, 150), 2)), "range52": maybe(r.random(), 0.5),
            "next_earnings_date": maybe(AS_OF + dt.timedelta(days=r.randint(-5, 25))),
            "return1m": maybe(r.uniform(-0.3, 0.3)), "return3m": maybe(r.uniform(-0.4, 0.4), 0.5),
            "return4m": maybe(r.uniform(-0.4, 0.4), 0.5), "return6m": maybe(r.uniform(-0.5, 0.5), 0.5), "is_custom": None,
        })
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in STOCK_SCHEMA.fieldNames()) for r in rows], STOCK_SCHEMA)


def bounded(x, low=0.0, high=100.0):
    return max(low, min(high, x))


def ladder(x, rungs, last, missing):
    if x is None:
        return missing
    return next((score for limit, score in rungs if limit(x)), last)


def below(*pairs):
    return [((lambda x, t=t: x < t), s) for t, s in pairs]


def at_most(*pairs):
    return [((lambda x, t=t: x <= t), s) for t, s in pairs]


def ratio(s):
    ok = s["price"] and s["forward_eps"] is not None and s["forward_eps"] > 0
    return s["price"] / s["forward_eps"] if ok else None


def judge(s, peers, cfg):
    """All model figures of one stock."""
    h = cfg.horizon
    price, eps, exit_pe = s["price"], s["forward_eps"], s["exit_pe"]
    growth = (s["eps_growth"] or 0) / 100
    rate = (cfg.default_discount if s["discount_rate"] is None else s["discount_rate"]) / 100
    earning = eps is not None and eps > 0
    priced_in = exit_pe is not None and exit_pe > 0

    def fair(shift, multiple, extra):
        if not (earning and priced_in):
            return None
        future = eps * (1 + max(-0.95, growth + shift / 100)) ** h.years
        return future * exit_pe * multiple / (1 + max(0, rate + extra / 100)) ** h.years

    out = {"current_pe": ratio(s), "bear_fv": fair(cfg.bear_growth_shift, 0.8, 2), "base_fv": fair(0, 1, 0), "bull_fv": fair(cfg.bull_growth_shift, 1.2, -1)}
    base, pe = out["base_fv"], out["current_pe"]
    up = base / price - 1 if base and price else None
    need = None
    if price and price > 0 and earning and priced_in:
        need = (price * (1 + rate) ** h.years / (eps * exit_pe)) ** (1 / h.years) - 1
    every = [ratio(p) for p in peers if ratio(p) is not None]
    near = [x for x in every if 0 < x < 500]
    middle = statistics.median(every) if every else None
    premium = pe / middle - 1 if pe and middle else None
    share = sum(x <= pe for x in near) / len(near) if pe is not None and len(near) >= 3 else None
    peg = pe / s["eps_growth"] if pe and s["eps_growth"] is not None and s["eps_growth"] > 3 else None
    gap = need - s["eps_growth"] / 100 if need is not None and s["eps_growth"] is not None else None
    weights = {f: getattr(cfg.weights, f) or 0 for f in RISK_FIELDS}
    parts = [(bounded(v, 1, 5), weights[f]) for f, v in zip(RISK_FIELDS, s["risk"]) if v is not None and weights[f] > 0]
    risk = sum(v * w for v, w in parts) / sum(w for _, w in parts) if parts else None
    order = ("return4m" if h.years < 0.8 else "return6m", "return3m", "return1m")
    mom = next((s[k] for k in order if s[k] is not None), None)
    days = (s["next_earnings_date"] - AS_OF).days if s["next_earnings_date"] else None
    place = s["range52"]
    if place is None and price and s["high52"] and s["low52"] and s["high52"] > s["low52"]:
        place = bounded((price - s["low52"]) / (s["high52"] - s["low52"]), 0, 1)
    if not (price and earning and base):
        status = "Need EPS"
    elif up >= 0.25:
        status = "Very undervalued"
    elif up >= 0.10:
        status = "Undervalued"
    elif up >= cfg.overvalued_threshold / 100:
        hot = premium is not None and premium > 0.3 and need is not None and need > growth + 0.04
        status = "Overvalued" if hot else "Okay"
    else:
        status = "Overvalued" if up >= -0.25 else "Very overvalued"
    trust = sum(p for ok, p in [
        (price is not None and price > 0, 15), (earning, 20), (s["eps_growth"] is not None, 15), (s["rev_growth"] is not None, 12),
        (s["gross_margin"] is not None, 8), (s["op_margin"] is not None, 10), (priced_in, 8), (s["fundamental_auto"], 12)] if ok)
    scores = {
        "upside": 40 if up is None else bounded(50 + 140 * up),
        "percentile": 50 if share is None else bounded(100 - 100 * share),
        "peg": ladder(peg, below((1.2, 95), (2.0, 78), (2.8, 55), (4.0, 32)), 12, 45),
        "gap": ladder(gap, at_most((0, 95), (0.03, 78), (0.06, 58), (0.10, 35)), 12, 45),
        "risk": 55 if risk is None else bounded(100 - 25 * (risk - 1)),
        "momentum": 50 if mom is None else bounded(50 + 120 * mom),
    }
    total = bounded(sum(scores[k] * getattr(h, k) for k in scores) * (0.72 + trust / 360))
    if days is not None and 0 <= days <= 7:
        total = bounded(total - 4)
    signs = [pe is not None and pe < 15, s["eps_growth"] is not None and s["eps_growth"] < 4, s["rev_growth"] is not None and s["rev_growth"] < 3,
             risk is not None and risk >= 3.6, mom is not None and mom < -0.12]
    trap = "Value Trap?" if sum(signs) >= 3 else "기대 높음" if gap is not None and gap > 0.08 else ""
    chips = [t for ok, t in [
        (share is not None and share < 0.35, "섹터 대비 저렴"), (gap is not None and gap <= 0.02, "성장률 부담 낮음"),
        (peg is not None and peg < 1.8, "PEG 양호"), (mom is not None and mom > 0.03, "모멘텀 양호"), (risk is not None and risk < 2.8, "리스크 낮음"),
        (up is not None and up > 0.1, "적정가 대비 여력"), (place is not None and place < 0.35, "52주 저점권"),
        (days is not None and 0 <= days <= 14, "실적 임박")] if ok]
    out.update(upside=up, required_growth=need, sector_premium=premium, pe_percentile=share, peg=peg, growth_gap=gap, risk_score=risk,
               return_h=mom, earnings_days=days, range_position=place, status=status, confidence=trust, short_score=total,
               value_trap=trap, reasons=chips[:4] or ["추가 확인 필요"])
    bear, bull = out["bear_fv"], out["bull_fv"]
    out["sensitivity"] = (bull - bear) / base if bear and base and bull else None
    return out


CONFIGS = [
    (ScreenConfig(), None),
    (ScreenConfig(analysis_mode=1), "sector"),
    (ScreenConfig(analysis_mode=5, overvalued_threshold=-5, weights=RiskWeights(2, 0, 1, None, 1, 1)), None),
    (replace(ScreenConfig(), analysis_mode=3, default_discount=8.0, bear_growth_shift=-10, bull_growth_shift=2), "sector"),
]


@pytest.mark.parametrize("cfg,peer_by", CONFIGS, ids=range(len(CONFIGS)))
def test_model(spark, cfg, peer_by):
    rows = make_stocks()
    got = {r["symbol"]: r for r in score(frame(spark, rows), cfg, AS_OF, peer_by=peer_by).collect()}
    seen = set()
    for s in rows:
        peers = rows if peer_by is None else [p for p in rows if p["sector"] == s["sector"]]
        for name, want in judge(s, peers, cfg).items():
            value = got[s["symbol"]][name]
            if isinstance(want, float):
                want = pytest.approx(want, rel=1e-9, abs=1e-9)
            assert value == want, (s["symbol"], name)
        seen.add(got[s["symbol"]]["status"])
    assert len(seen) == 6


def test_properties(spark):
    out = score(frame(spark, make_stocks(seed=9)), ScreenConfig(), AS_OF)
    bad = out.where(~F.col("short_score").between(0, 100) | F.col("short_score").isNull() | (F.col("bear_fv") > F.col("base_fv")) | (F.col("base_fv") > F.col("bull_fv")))
    assert bad.count() == 0
    again = score(frame(spark, make_stocks(seed=9)).repartition(11), ScreenConfig(), AS_OF)
    assert out.exceptAll(again).count() == 0

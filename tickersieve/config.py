"""Driver-side parameters and the fixed values the results depend on."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from typing import Any

RISK_FIELDS = ("rate", "cyc", "margin", "balance", "crowding", "reg")

# Per-sector default assumptions, in percent, then the six risk
# sub-scores (1 low .. 5 high) in the order of RISK_FIELDS.
# sector: (eps growth, revenue growth, gross margin, operating margin, exit PE, discount rate, risks)
SECTOR_DEFAULTS = {
    "Communication Services": (9, 7, 55, 25, 21, 9.5, (2.6, 3.1, 3.0, 2.2, 3.4, 3.5)),
    "Consumer Discretionary": (8, 6, 42, 12, 21, 10.0, (3.2, 3.8, 3.4, 2.8, 3.1, 2.3)),
    "Consumer Staples": (5, 4, 38, 18, 19, 8.5, (2.2, 1.9, 2.8, 2.3, 2.5, 2.2)),
    "Energy": (3, 3, 35, 18, 10, 11.0, (2.8, 4.4, 4.1, 3.1, 2.3, 4.0)),
    "Financials": (6, 5, 0, 28, 13, 10.0, (4.0, 3.6, 3.0, 3.8, 2.5, 3.5)),
    "Health Care": (8, 6, 65, 24, 18, 9.0, (2.0, 2.1, 2.9, 2.4, 2.5, 4.0)),
    "Industrials": (7, 5, 34, 16, 19, 9.5, (2.8, 3.7, 3.2, 2.7, 2.7, 2.6)),
    "Information Technology": (12, 9, 58, 30, 27, 10.0, (3.4, 3.2, 3.0, 2.1, 4.2, 3.2)),
    "Materials": (4, 4, 31, 14, 15, 10.0, (2.9, 4.0, 3.8, 2.9, 2.1, 2.8)),
    "Real Estate": (3, 3, 0, 35, 17, 10.5, (4.5, 3.4, 2.8, 4.1, 2.0, 2.4)),
    "Utilities": (4, 4, 0, 24, 17, 8.5, (4.0, 1.8, 2.4, 3.7, 2.2, 3.2)),
    "Watchlist": (8, 7, 45, 15, 18, 11.0, (3.6, 4.0, 3.6, 3.5, 3.3, 2.8)),
}
FALLBACK_SECTOR = "Industrials"
MISSING_SECTOR = "Other"
WATCHLIST_SECTOR = "Watchlist"
ALL = "All"

# The order sectors are listed in.
SECTOR_ORDER = (
    "Watchlist",
    "Communication Services",
    "Consumer Discretionary",
    "Consumer Staples",
    "Energy",
    "Financials",
    "Health Care",
    "Industrials",
    "Information Technology",
    "Materials",
    "Real Estate",
    "Utilities",
)

# Display labels.
SECTOR_LABELS = {
    "All": "전체",
    "Watchlist": "관심종목",
    "Communication Services": "커뮤니케이션 서비스",
    "Consumer Discretionary": "임의소비재",
    "Consumer Staples": "필수소비재",
    "Energy": "에너지",
    "Financials": "금융",
    "Health Care": "헬스케어",
    "Industrials": "산업재",
    "Information Technology": "정보기술",
    "Materials": "소재",
    "Real Estate": "부동산",
    "Utilities": "유틸리티",
    "Other": "기타",
}
STATUS_LABELS = {
    "Very undervalued": "매우 저평가",
    "Undervalued": "저평가",
    "Okay": "적정",
    "Overvalued": "고평가",
    "Very overvalued": "매우 고평가",
    "Need EPS": "EPS 필요",
}
OVERVALUED = ("Overvalued", "Very overvalued")

# Provenance texts stored with the data.
SOURCE_PRICE_JOB = "Yahoo EOD via GitHub Actions/yfinance"
SOURCE_PRICE_DEFAULT = "Yahoo EOD via GitHub Actions"
SOURCE_FUND_JOB = "Yahoo Finance fundamentals via yfinance/GitHub Actions"
SOURCE_FUND_DEFAULT = "Yahoo fundamentals via GitHub Actions"
SOURCE_MANUAL_PRICE = "manual"
SOURCE_SECTOR_DEFAULT = "섹터 기본값"
SOURCE_SHARED_LIST = "공유 관심종목"
SOURCE_MANUAL_INPUT = "수동 입력"
SHARED_LIST_LABEL = "관심종목"

# Texts shown where there is nothing else to say, and for flags.
DEFAULT_CHIP = "추가 확인 필요"
TRAP_TEXT = "Value Trap?"
HIGH_HOPES_TEXT = "기대 높음"
MISSING_TEXT = "–"


@dataclass(frozen=True)
class Horizon:
    years: float
    label: str
    upside: float
    percentile: float
    peg: float
    gap: float
    risk: float
    momentum: float


# Fixed values: (upper bound of the setting, profile); the last one is open.
HORIZONS = (
    (0.8, Horizon(1.0 / 3.0, "4개월 스윙", 0.14, 0.18, 0.14, 0.16, 0.13, 0.25)),
    (2.0, Horizon(1.0, "1년 단기", 0.20, 0.18, 0.16, 0.18, 0.13, 0.15)),
    (4.0, Horizon(3.0, "3년 중기", 0.25, 0.16, 0.17, 0.22, 0.12, 0.08)),
    (float("inf"), Horizon(5.0, "5년 기본", 0.30, 0.14, 0.17, 0.24, 0.10, 0.05)),
)


@dataclass(frozen=True)
class RiskWeights:
    rate: float | None = 1.0
    cyc: float | None = 1.1
    margin: float | None = 1.0
    balance: float | None = 1.0
    crowding: float | None = 1.2
    reg: float | None = 0.8


def leading_number(text: str) -> float | None:
    """The number a setting starts with: '1y' is 1."""
    found = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", text)
    return float(found[1]) if found else None


@dataclass(frozen=True)
class ScreenConfig:
    """Screen settings; every operator takes them as literals folded into its plan."""

    years: float | str | None = 0.33
    analysis_mode: float | str | None = 0.33
    default_eps: float = 5.0
    default_discount: float = 10.0
    bear_growth_shift: float = -5.0
    bull_growth_shift: float = 5.0
    overvalued_threshold: float = -10.0
    weights: RiskWeights = field(default_factory=RiskWeights)
    blank_numeric: str = "null"  # 'null' or 'zero': what an empty snapshot cell means
    selected_sector: str = ALL
    search: str = ""
    status_filter: str = ALL
    sort_key: str = "symbol"
    sort_descending: bool = False

    def __post_init__(self) -> None:
        if self.blank_numeric not in ("null", "zero"):
            raise ValueError("blank_numeric must be 'null' or 'zero'")

    @property
    def horizon(self) -> Horizon:
        raw = self.analysis_mode if self.analysis_mode is not None else self.years
        setting = 0.33 if raw is None else leading_number(str(raw))
        if setting is None:
            return HORIZONS[-1][1]
        return next((p for bound, p in HORIZONS if setting < bound), HORIZONS[-1][1])

    def merged_with(self, saved: dict[str, Any]) -> "ScreenConfig":
        """Saved settings over these ones; weights are merged one by one."""
        known = {f.name for f in fields(self)} - {"weights"}
        top = {k: v for k, v in saved.items() if k in known}
        saved_weights = {k: v for k, v in (saved.get("weights") or {}).items() if k in RISK_FIELDS}
        return replace(self, **top, weights=replace(self.weights, **saved_weights))

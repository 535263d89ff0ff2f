"""Equity screening as Spark DataFrame operators."""

from tickersieve.config import RiskWeights, ScreenConfig

__all__ = ["RiskWeights", "ScreenConfig"]

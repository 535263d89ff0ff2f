"""Column lists and types of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

from tickersieve.config import RISK_FIELDS

RISK_TYPE = T.StructType([T.StructField(name, T.DoubleType()) for name in RISK_FIELDS])

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

STOCK_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("sub_industry", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("price_source", T.StringType()),
        T.StructField("forward_eps", T.DoubleType()),
        T.StructField("rev_growth", T.DoubleType()),
        T.StructField("eps_growth", T.DoubleType()),
        T.StructField("gross_margin", T.DoubleType()),
        T.StructField("op_margin", T.DoubleType()),
        T.StructField("exit_pe", T.DoubleType()),
        T.StructField("discount_rate", T.DoubleType()),
        T.StructField("risk", RISK_TYPE),
        T.StructField("notes", T.StringType()),
        T.StructField("fundamental_source", T.StringType()),
        T.StructField("fundamental_auto", T.BooleanType()),
        T.StructField("fundamental_manual", T.BooleanType()),
        T.StructField("risk_auto", T.BooleanType()),
        T.StructField("high52", T.DoubleType()),
        T.StructField("low52", T.DoubleType()),
        T.StructField("range52", T.DoubleType()),
        T.StructField("next_earnings_date", T.DateType()),
        T.StructField("return1m", T.DoubleType()),
        T.StructField("return3m", T.DoubleType()),
        T.StructField("return4m", T.DoubleType()),
        T.StructField("return6m", T.DoubleType()),
        T.StructField("is_custom", T.BooleanType()),
    ]
)
STOCK_COLUMNS = STOCK_SCHEMA.fieldNames()

# Column order of the two snapshot files.
PRICE_COLUMNS = (
    "symbol",
    "yahooSymbol",
    "date",
    "close",
    "adjClose",
    "volume",
    "avgVolume3m",
    "ma20",
    "ma50",
    "ma200",
    "volatility4m",
    "maxDrawdown4m",
    "high52",
    "low52",
    "range52",
    "distance52High",
    "distance52Low",
    "return1m",
    "return3m",
    "return4m",
    "return6m",
    "source",
    "updatedAt",
)
FUND_COLUMNS = (
    "symbol",
    "yahooSymbol",
    "shortName",
    "sector",
    "industry",
    "forwardEps",
    "trailingEps",
    "forwardPE",
    "trailingPE",
    "pegRatio",
    "revenueGrowth",
    "earningsGrowth",
    "grossMargins",
    "operatingMargins",
    "profitMargins",
    "debtToEquity",
    "currentRatio",
    "quickRatio",
    "totalDebt",
    "totalCash",
    "beta",
    "marketCap",
    "fiftyTwoWeekHigh",
    "fiftyTwoWeekLow",
    "earningsTimestamp",
    "nextEarningsDate",
    "source",
    "updatedAt",
    "error",
)
FUND_TEXT_COLUMNS = frozenset(
    (
        "symbol",
        "yahooSymbol",
        "shortName",
        "sector",
        "industry",
        "source",
        "updatedAt",
        "error",
    )
)

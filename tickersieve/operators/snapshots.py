"""Price and fundamentals snapshots: reading their columns and merging them onto stocks.

Stock rows carry normalised symbols, so every merge joins on the plain column and keeps the
partitioning of the stock table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersieve.config import (
    RISK_FIELDS,
    SOURCE_FUND_DEFAULT,
    SOURCE_MANUAL_INPUT,
    SOURCE_MANUAL_PRICE,
    SOURCE_PRICE_DEFAULT,
    ScreenConfig,
)
from tickersieve.functions.dates import epoch_to_date, text_to_date
from tickersieve.functions.numbers import (
    blank_to_null,
    parse_loose,
    parse_prefix,
    parse_strict,
    percent_from_text,
    positive,
    truthy,
)
from tickersieve.functions.symbols import normalize_symbol
from tickersieve.functions.valuation import (
    balance_risk,
    crowding_risk,
    cyclical_risk,
    margin_risk,
)
from tickersieve.operators.rows import last_per_key
from tickersieve.sources.headers import column_or_null, find_column

PRICE_EXTRAS = ("return1m", "return3m", "return4m", "return6m", "high52", "low52", "range52")

# Header spellings of each logical fundamentals column, best first.
FUND_ALIASES = {
    "symbol": ("symbol",),
    "forward_eps": ("forwardEps", "forward_eps"),
    "trailing_eps": ("trailingEps", "trailing_eps"),
    "forward_pe": ("forwardPE", "forward_pe"),
    "revenue_growth": ("revenueGrowth", "revenue_growth"),
    "earnings_growth": ("earningsGrowth", "earnings_growth", "epsGrowth", "eps_growth"),
    "gross_margins": ("grossMargins", "grossMargin", "gross_margins", "gross_margin"),
    "operating_margins": (
        "operatingMargins",
        "operatingMargin",
        "operating_margins",
        "operating_margin",
    ),
    "debt_to_equity": ("debtToEquity", "debt_to_equity"),
    "beta": ("beta",),
    "next_earnings_date": ("nextEarningsDate", "earningsDate", "earnings_date"),
    "earnings_timestamp": ("earningsTimestamp", "earningsTimestampStart", "earnings_timestamp"),
    "source": ("source",),
    "updated_at": ("updatedAt", "updated_at"),
}


def resolve_price_snapshot(raw: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Raw text columns to typed price rows; rows without a positive price are dropped.

    A close of '0' is a price of zero, not a missing close, so adjClose does not replace it.
    """
    close_col, adj_col = find_column(raw, "close"), find_column(raw, "adjclose")
    if find_column(raw, "symbol") is None or (close_col is None and adj_col is None):
        raise ValueError("a price snapshot needs the columns symbol and close or adjClose")
    cells = [F.col(f"`{c}`") for c in (close_col, adj_col) if c is not None]
    price = parse_strict(F.coalesce(*[blank_to_null(c.cast("string")) for c in cells]))

    def text(*names: str) -> Column:
        return column_or_null(raw, *names).cast("string")

    source = text("source") if find_column(raw, "source") else F.lit(SOURCE_PRICE_DEFAULT)
    return raw.select(
        normalize_symbol(text("symbol")).alias("symbol"),
        price.alias("price"),
        text("date").alias("date"),
        source.alias("source"),
        text("updatedat").alias("updated_at"),
        *[parse_loose(text(c), cfg.blank_numeric).alias(c) for c in PRICE_EXTRAS],
        column_or_null(raw, "ordinal").cast("long").alias("ordinal"),
    ).where(positive(F.col("price")))


def merge_prices(stocks: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Set price and source from the last snapshot row of each symbol; extras where present."""
    latest = last_per_key(snapshot, "symbol").select(
        "symbol", F.struct("price", "date", "source", *PRICE_EXTRAS).alias("_snap")
    )
    snap = F.col("_snap")
    source = F.concat(
        F.coalesce(blank_to_null(snap["source"]), F.lit(SOURCE_PRICE_DEFAULT)),
        F.coalesce(F.concat(F.lit(" "), blank_to_null(snap["date"])), F.lit("")),
    )
    joined = stocks.join(latest, "symbol", "left")
    return joined.withColumns(
        {
            "price_source": F.when(snap.isNotNull(), source).otherwise(F.col("price_source")),
            "price": F.coalesce(snap["price"], F.col("price")),
            **{name: F.coalesce(snap[name], F.col(name)) for name in PRICE_EXTRAS},
        }
    ).select(*stocks.columns)


def resolve_fund_snapshot(raw: DataFrame) -> DataFrame:
    """Raw text columns under any known header spelling to the logical text columns."""
    if find_column(raw, "symbol") is None:
        raise ValueError("a fundamentals snapshot needs the column symbol")
    columns = [
        column_or_null(raw, *names).cast("string").alias(logical)
        for logical, names in FUND_ALIASES.items()
        if logical != "symbol"
    ]
    return raw.select(
        normalize_symbol(column_or_null(raw, "symbol")).alias("symbol"),
        *columns,
        F.lit(find_column(raw, "source") is not None).alias("has_source"),
        column_or_null(raw, "ordinal").cast("long").alias("ordinal"),
    )


_ASSUMPTIONS = ("forward_eps", "rev_growth", "eps_growth", "gross_margin", "op_margin", "exit_pe")
_DERIVED_RISKS = ("balance", "crowding", "cyc", "margin")


def _offers(blank: str) -> list[Column]:
    """What a fundamentals row offers: new assumptions, risk scores, date and source."""

    def number(name: str) -> Column:
        return parse_loose(F.col(name), blank)

    def percent(name: str) -> Column:
        return percent_from_text(F.col(name), blank)

    forward, trailing, pe = number("forward_eps"), number("trailing_eps"), number("forward_pe")
    stamp = number("earnings_timestamp")
    date_text = blank_to_null(F.col("next_earnings_date"))
    stamp_day = F.when(truthy(stamp), epoch_to_date(stamp, positive_only=False))
    source = F.when(F.col("has_source"), F.coalesce(F.col("source"), F.lit(""))).otherwise(
        SOURCE_FUND_DEFAULT
    )
    stamped = F.coalesce(F.concat(F.lit(" "), blank_to_null(F.col("updated_at"))), F.lit(""))
    return [
        F.when(forward > 0.0, forward).when(trailing > 0.0, trailing).alias("_new_forward_eps"),
        percent("revenue_growth").alias("_new_rev_growth"),
        percent("earnings_growth").alias("_new_eps_growth"),
        percent("gross_margins").alias("_new_gross_margin"),
        percent("operating_margins").alias("_new_op_margin"),
        F.when((pe > 0.0) & (pe < 120.0), pe).alias("_new_exit_pe"),
        balance_risk(number("debt_to_equity")).alias("_risk_balance"),
        crowding_risk(pe).alias("_risk_crowding"),
        cyclical_risk(number("beta")).alias("_risk_cyc"),
        margin_risk(percent("operating_margins")).alias("_risk_margin"),
        (date_text.isNotNull() | stamp_day.isNotNull()).alias("_has_date"),
        F.when(date_text.isNotNull(), text_to_date(date_text)).otherwise(stamp_day).alias("_date"),
        F.concat(source, stamped).alias("_source"),
    ]


def fundamental_updates(
    stocks: DataFrame, snapshot: DataFrame, cfg: ScreenConfig, overwrite: bool = True
) -> DataFrame:
    """Stocks merged with the last fundamentals row per symbol, plus what changed.

    Adds the flags `matched`, `assumption_touched` and `touched`.
    """
    blank = cfg.blank_numeric
    latest = last_per_key(snapshot, "symbol").select(
        "symbol", F.lit(True).alias("_matched"), *_offers(blank)
    )
    joined = stocks.join(latest, "symbol", "left")

    def open_for(name: str) -> Column:
        return F.lit(True) if overwrite else F.col(name).isNull()

    def takes(name: str) -> Column:
        return F.col(f"_new_{name}").isNotNull() & open_for(name)

    risk_open = F.lit(True) if overwrite else ~F.coalesce(F.col("risk_auto"), F.lit(False))
    any_assumption = reduce(or_, [takes(name) for name in _ASSUMPTIONS])
    any_risk = reduce(or_, [F.col(f"_risk_{r}").isNotNull() for r in _DERIVED_RISKS]) & risk_open
    matched = F.col("_matched").isNotNull()
    touched = any_assumption | any_risk | F.coalesce(F.col("_has_date"), F.lit(False))
    risk = F.struct(
        *[
            (
                F.when(risk_open, F.coalesce(F.col(f"_risk_{r}"), F.col("risk")[r])).otherwise(
                    F.col("risk")[r]
                )
                if r in _DERIVED_RISKS
                else F.col("risk")[r]
            ).alias(r)
            for r in RISK_FIELDS
        ]
    )
    flagged = joined.withColumns(
        {"matched": matched, "assumption_touched": any_assumption, "touched": touched}
    )
    return flagged.withColumns(
        {
            **{
                k: F.when(takes(k), F.col(f"_new_{k}")).otherwise(F.col(k))
                for k in _ASSUMPTIONS
            },
            "next_earnings_date": F.when(F.col("_has_date"), F.col("_date")).otherwise(
                F.col("next_earnings_date")
            ),
            "fundamental_auto": F.col("assumption_touched")
            | F.coalesce(F.col("fundamental_auto"), F.lit(False)),
            "fundamental_manual": ~F.col("assumption_touched")
            & F.coalesce(F.col("fundamental_manual"), F.lit(False)),
            "fundamental_source": F.when(F.col("matched"), F.col("_source")).otherwise(
                F.col("fundamental_source")
            ),
            "risk": F.when(F.col("matched"), risk).otherwise(F.col("risk")),
            "risk_auto": F.col("touched") | F.coalesce(F.col("risk_auto"), F.lit(False)),
        }
    ).select(*stocks.columns, "matched", "assumption_touched", "touched")


def merge_fundamentals(
    stocks: DataFrame, snapshot: DataFrame, cfg: ScreenConfig, overwrite: bool = True
) -> DataFrame:
    merged = fundamental_updates(stocks, snapshot, cfg, overwrite)
    return merged.drop("matched", "assumption_touched", "touched")


def merge_counts(updates: DataFrame) -> DataFrame:
    """One row: stocks with a snapshot row, with a new assumption, with any change."""
    return updates.agg(
        F.count_if("matched").alias("matched_rows"),
        F.count_if("assumption_touched").alias("usable_rows"),
        F.count_if("touched").alias("updated_rows"),
    )


# Names of the editable fields and the stock columns they set.
OVERRIDE_FIELDS = {
    "price": "price",
    "forwardEPS": "forward_eps",
    "epsGrowth": "eps_growth",
    "revGrowth": "rev_growth",
    "grossMargin": "gross_margin",
    "opMargin": "op_margin",
    "exitPE": "exit_pe",
    "discountRate": "discount_rate",
}


def apply_overrides(stocks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply user edits (`symbol, field, value, ordinal`), the last one per field.

    An edit with an unreadable value clears the field.
    """
    names = {**OVERRIDE_FIELDS, **{f"risk.{r}": f"risk.{r}" for r in RISK_FIELDS}}
    number = parse_prefix(F.col("value"))
    edits = overrides.groupBy(normalize_symbol(F.col("symbol")).alias("symbol")).agg(
        *[
            F.max_by(number, F.when(F.col("field") == field, F.col("ordinal"))).alias(f"_v_{i}")
            for i, field in enumerate(names)
        ],
        *[
            F.count_if(F.col("field") == field).alias(f"_n_{i}")
            for i, field in enumerate(names)
        ],
    )
    joined = stocks.join(edits, "symbol", "left")
    slot = {field: i for i, field in enumerate(names)}

    def edited(field: str) -> Column:
        return F.coalesce(F.col(f"_n_{slot[field]}") > 0, F.lit(False))

    def value(field: str, current: Column) -> Column:
        return F.when(edited(field), F.col(f"_v_{slot[field]}")).otherwise(current)

    assumption = F.lit(False)
    for field in OVERRIDE_FIELDS:
        if field != "price":
            assumption = assumption | edited(field)
    return joined.withColumns(
        {
            **{column: value(f, F.col(column)) for f, column in OVERRIDE_FIELDS.items()},
            "risk": F.struct(
                *[value(f"risk.{r}", F.col("risk")[r]).alias(r) for r in RISK_FIELDS]
            ),
            "price_source": F.when(edited("price"), SOURCE_MANUAL_PRICE).otherwise(
                F.col("price_source")
            ),
            "fundamental_manual": assumption | F.coalesce(F.col("fundamental_manual"), F.lit(False)),
            "fundamental_auto": ~assumption & F.coalesce(F.col("fundamental_auto"), F.lit(False)),
            "fundamental_source": F.when(assumption, SOURCE_MANUAL_INPUT).otherwise(
                F.col("fundamental_source")
            ),
        }
    ).select(*stocks.columns)

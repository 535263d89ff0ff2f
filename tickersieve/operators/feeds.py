"""Vendor JSON to prices and fundamentals, and choosing among several feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersieve.config import SOURCE_FUND_JOB
from tickersieve.functions.dates import as_date, epoch_to_date, recent_weekdays
from tickersieve.functions.numbers import (
    blank_to_null,
    finite,
    first_present,
    parse_prefix,
    parse_strict,
    truthy,
)
from tickersieve.functions.symbols import normalize_symbol, to_api_symbol
from tickersieve.operators.rows import keep_by
from tickersieve.schemas import FUND_COLUMNS, FUND_TEXT_COLUMNS
from tickersieve.sources.store import store

# Numbers are read as texts, so that a quoted one is a number too and an odd one costs no record.
CHART_DDL = (
    "chart struct<result: array<struct<timestamp: array<string>, indicators: struct<quote: "
    "array<struct<close: array<string>>>>>>, error: struct<code: string, description: string>>"
)
_QUOTE = "date: string, close: string, adjClose: string, price: string"
_HISTORY = f"array<struct<{_QUOTE}>>"
_HISTORY_OBJECT_DDL = (
    f"symbol string, historical {_HISTORY}, "
    f"historicalStockList array<struct<symbol: string, historical: {_HISTORY}>>"
)
_HISTORY_LIST_DDL = (
    f"array<struct<symbol: string, ticker: string, historical: {_HISTORY}, "
    f"{_QUOTE}>>"
)
_ROWS = f"array<struct<symbol: string, ticker: string, {_QUOTE}>>"
_WRAPPED_DDL = f"historical {_ROWS}, data {_ROWS}"

# Fields of a fundamentals record, by snapshot column.
INFO_FIELDS = (
    "shortName",
    "longName",
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
    "earningsTimestampStart",
    "earningsTimestampEnd",
)
MAX_ERROR_LENGTH = 220


def chart_last_close(charts: DataFrame, json_col: str = "json") -> DataFrame:
    """Last finite close of each chart record, its day, or why there is none.

    Output: `symbol, price, date, error`; `date` is NULL if the close has no timestamp.
    """
    parsed = charts.select("symbol", F.from_json(json_col, CHART_DDL).alias("r")).select(
        "symbol",
        F.col("r.chart.error").alias("failure"),
        F.get(F.col("r.chart.result"), F.lit(0)).alias("result"),
    )
    closes = F.get(F.col("result.indicators.quote"), F.lit(0))["close"]
    pairs = F.arrays_zip(
        closes.alias("close"), F.col("result.timestamp").alias("time")
    )
    usable = F.filter(
        F.coalesce(pairs, F.array()),
        lambda p: parse_strict(p["close"], "zero").isNotNull(),
    )
    last = F.try_element_at(usable, F.lit(-1))
    failure = F.col("failure")
    error = (
        F.when(
            failure.isNotNull(),
            F.coalesce(
                blank_to_null(failure["description"]),
                blank_to_null(failure["code"]),
                F.lit("chart error"),
            ),
        )
        .when(F.col("result").isNull(), "empty result")
        .when(last.isNull(), "no valid close")
    )
    return parsed.select("symbol", "result", last.alias("last"), error.alias("error")).select(
        normalize_symbol(F.col("symbol")).alias("symbol"),
        F.when(F.col("error").isNull(), parse_strict(F.col("last.close"), "zero")).alias("price"),
        F.when(
            F.col("error").isNull(), epoch_to_date(parse_strict(F.col("last.time")).cast("long"))
        ).alias("date"),
        "error",
    )


def price_api_latest(responses: DataFrame, json_col: str = "json") -> DataFrame:
    """First history entry of every stock in a response, whichever of the three shapes it has.

    Shapes: `{historicalStockList: [{symbol, historical}]}`, `{symbol, historical}`, or a list
    of such objects or of plain quotes. Price is the first of close, adjClose, price.
    """
    text = F.col(json_col)
    # A JSON array parses as its objects, so each parser only sees the texts of its own shape.
    is_list = F.startswith(F.ltrim(text), F.lit("["))
    one = F.from_json(F.when(~is_list, text), _HISTORY_OBJECT_DDL)
    many = F.from_json(F.when(is_list, text), _HISTORY_LIST_DDL)
    parsed = responses.select(one.alias("one"), many.alias("many"))

    def latest(history: Column) -> Column:
        return F.get(history, F.lit(0))

    def entry(symbol: Column, row: Column) -> Column:
        return F.struct(
            symbol.alias("symbol"),
            row["date"].alias("date"),
            row["close"].alias("close"),
            row["adjClose"].alias("adjClose"),
            row["price"].alias("price"),
        )

    listed = F.transform(
        F.col("one.historicalStockList"), lambda s: entry(s["symbol"], latest(s["historical"]))
    )
    single = F.array(entry(F.col("one.symbol"), latest(F.col("one.historical"))))

    def flat(item: Column) -> Column:
        first = latest(item["historical"])
        row = F.when(first.isNotNull(), first).otherwise(
            F.struct(item["date"], item["close"], item["adjClose"], item["price"])
        )
        return entry(F.coalesce(blank_to_null(item["symbol"]), item["ticker"]), row)

    stocks = (
        F.when(F.col("many").isNotNull(), F.transform(F.col("many"), flat))
        .when(F.col("one.historicalStockList").isNotNull(), listed)
        .when(blank_to_null(F.col("one.symbol")).isNotNull(), single)
    )
    price = parse_prefix(F.coalesce(F.col("close"), F.col("adjClose"), F.col("price")))
    return (
        parsed.select(F.inline(stocks))
        .where("symbol is not null and symbol != ''")
        .select(normalize_symbol(F.col("symbol")).alias("symbol"), price.alias("price"), "date")
        .where(truthy(F.col("price")))
    )


def _quote_rows(responses: DataFrame, json_col: str, wrappers: tuple[str, str]) -> DataFrame:
    """Rows of responses that are a list or hold one under either name: the other columns of the
    response, `position` in it, and the row's fields as texts."""
    text = F.col(json_col)
    is_list = F.startswith(F.ltrim(text), F.lit("["))
    wrapped = F.from_json(F.when(~is_list, text), _WRAPPED_DDL)
    many = F.from_json(F.when(is_list, text), _ROWS)
    rows = F.coalesce(many, *[wrapped[name] for name in wrappers])
    others = [c for c in responses.columns if c != json_col]
    return responses.select(*others, F.posexplode(rows).alias("position", "r"))


def light_rows(responses: DataFrame, json_col: str = "json") -> DataFrame:
    """`symbol, json` responses of the light feed to typed quotes for `light_latest`."""
    rows = _quote_rows(responses.select("symbol", json_col), json_col, ("historical", "data"))
    fields = {"price": "price", "close": "close", "adj_close": "adjClose"}
    return rows.select(
        "symbol",
        F.col("r.date").alias("date"),
        *[parse_prefix(F.col(f"r.{name}")).alias(column) for column, name in fields.items()],
        F.col("position").cast("long").alias("ordinal"),
    )


def bulk_rows(responses: DataFrame, json_col: str = "json") -> DataFrame:
    """`date, json` responses of the bulk feed, one per day, to typed quotes for
    `bulk_latest_date`; a row's symbol may be under `symbol` or `ticker`."""
    rows = _quote_rows(responses.select("date", json_col), json_col, ("data", "historical"))
    fields = {"price": "price", "close": "close", "adj_close": "adjClose"}
    return rows.select(
        F.coalesce(blank_to_null(F.col("r.symbol")), F.col("r.ticker")).alias("symbol"),
        F.col("date").cast("date").alias("date"),
        *[parse_prefix(F.col(f"r.{name}")).alias(column) for column, name in fields.items()],
    ).where(blank_to_null(F.col("symbol")).isNotNull())


def light_latest(quotes: DataFrame) -> DataFrame:
    """Newest quote per symbol; price is the first of price, close, adjClose of that quote."""
    order = [F.col("date").desc_nulls_last()]
    if "ordinal" in quotes.columns:
        order.append(F.col("ordinal").asc())
    keyed = quotes.withColumn("symbol", normalize_symbol(F.col("symbol")))
    price = finite(F.coalesce(F.col("price"), F.col("close"), F.col("adj_close")))
    return (
        keep_by(keyed, "symbol", *order)
        .select("symbol", price.alias("price"), "date")
        .where(truthy(F.col("price")))
    )


def bulk_latest_date(
    quotes: DataFrame, wanted: DataFrame, as_of: str | dt.date, days_back: int = 9
) -> DataFrame:
    """Quotes of the latest recent weekday on which any wanted symbol has a price."""
    symbols = wanted.select(normalize_symbol(F.col("symbol")).alias("symbol"))
    price = finite(F.coalesce(F.col("close"), F.col("adj_close"), F.col("price")))
    today = as_date(as_of)
    recent = quotes.where(
        F.col("date").between(F.date_sub(today, days_back - 1), today)
        & F.array_contains(recent_weekdays(as_of, days_back), F.col("date"))
    ).select(normalize_symbol(F.col("symbol")).alias("symbol"), price.alias("price"), "date")
    # Written once: the newest date and its rows would each parse the responses again.
    usable = store(recent.where(truthy(F.col("price"))).join(symbols, "symbol", "left_semi"), "bulk-quotes")
    newest = usable.agg(F.max("date").alias("newest")).scalar()
    return usable.where(F.col("date") == newest)


def info_to_fundamentals(
    records: DataFrame, updated_at: str, json_col: str = "json", source: str = SOURCE_FUND_JOB
) -> DataFrame:
    """One fundamentals row per record (`symbol, json` and optionally `error`).

    A record with an error, or one that is no JSON object, keeps only its keys and the error.
    """
    fields = ", ".join(f"{name} string" for name in INFO_FIELDS)
    known = F.col("error") if "error" in records.columns else F.lit(None).cast("string")
    parsed = records.select(
        "symbol", blank_to_null(known).alias("error"), F.from_json(json_col, fields).alias("r")
    )
    ok = F.col("error").isNull()

    def text(name: str) -> Column:
        return F.when(ok, blank_to_null(F.col(f"r.{name}")))

    def number(name: str) -> Column:
        return F.when(ok, finite(F.col(f"r.{name}").try_cast("double")))

    stamp = finite(
        first_present(
            *[F.col(f"r.earningsTimestamp{suffix}") for suffix in ("", "Start", "End")]
        ).try_cast("double")
    )
    special = {
        "symbol": normalize_symbol(F.col("symbol")),
        "yahooSymbol": to_api_symbol(F.col("symbol")),
        "shortName": F.coalesce(text("shortName"), text("longName")),
        "earningsTimestamp": F.when(ok, stamp),
        "nextEarningsDate": F.when(ok, epoch_to_date(stamp)),
        "source": F.lit(source),
        "updatedAt": F.lit(updated_at),
        "error": F.left(F.col("error"), F.lit(MAX_ERROR_LENGTH)),
    }
    for name in FUND_COLUMNS:
        if name not in special:
            special[name] = text(name) if name in FUND_TEXT_COLUMNS else number(name)
    return parsed.select(*[special[name].alias(name) for name in FUND_COLUMNS])


def price_waterfall(stocks: DataFrame, *feeds: DataFrame) -> DataFrame:
    """Prices (`symbol, price, date`) of the first feed that prices any stock at all.

    Feeds are tried in turn and their matches written down, so that each is read at most once
    and those after the first useful one not at all.
    """
    symbols = stocks.select(normalize_symbol(F.col("symbol")).alias("symbol"))
    matches = None
    for rank, feed in enumerate(feeds):
        symbol = normalize_symbol(F.col("symbol")).alias("symbol")
        priced = feed.select(symbol, "price", "date", F.lit(rank).alias("feed"))
        usable = priced.where(truthy(F.col("price"))).join(symbols, "symbol", "left_semi")
        matches = store(usable, "feed-matches")
        if not matches.isEmpty():
            break
    if matches is None:
        raise ValueError("at least one feed is needed")
    return matches


def price_candidates(candidates: DataFrame) -> DataFrame:
    """Per symbol, the first candidate (by `rank`) that holds a price and no error."""
    usable = candidates.where(
        truthy(finite(F.col("price"))) & blank_to_null(F.col("error")).isNull()
    )
    keyed = usable.withColumn("symbol", normalize_symbol(F.col("symbol")))
    return keep_by(keyed, "symbol", F.col("rank").asc()).select("symbol", "price", "date", "rank")

"""Quotes from a folder of vendor records of any shape, each parsed once, as a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersieve.functions.dates import epoch_to_date
from tickersieve.functions.numbers import blank_to_null, parse_prefix, parse_strict, truthy
from tickersieve.functions.symbols import normalize_symbol

_QUOTE = "date string, close string, adjClose string, price string"
_ITEM = f"struct<symbol string, ticker string, {_QUOTE}, historical array<struct<{_QUOTE}>>>"
_ENTRY = "struct<shape string, symbol string, date string, price double>"


def _at(path: str, kind: str) -> Column:
    """What is at the path, NULL where it is missing or of another kind."""
    return F.try_variant_get("v", path, kind)


def _entry(shape: str, symbol: Column, date: Column, price: Column) -> Column:
    return F.struct(F.lit(shape).alias("shape"), symbol.alias("symbol"), date.alias("date"), price.alias("price"))


def _price(quote: Column, *order: str) -> Column:
    return parse_prefix(F.coalesce(*[quote[name] for name in order]))


def _chart() -> Column:
    """The last finite close of a chart, with its day if it has a timestamp."""
    closes = _at("$.chart.result[0].indicators.quote[0].close", "array<string>")
    times = F.coalesce(_at("$.chart.result[0].timestamp", "array<string>"), F.array().cast("array<string>"))
    pairs = F.filter(F.arrays_zip(closes.alias("close"), times.alias("time")), lambda p: parse_strict(p["close"]).isNotNull())
    last = F.try_element_at(pairs, F.lit(-1))
    day = epoch_to_date(parse_strict(last["time"]).cast("long")).cast("string")
    return F.array(_entry("chart", F.col("symbol"), day, parse_strict(last["close"])))


def _listed(items: Column) -> Column:
    """Items of a list: with a history its first entry, otherwise the item itself is the quote."""

    def quote(item: Column) -> Column:
        first = F.get(item["historical"], F.lit(0))
        own = F.struct(*[item[c].alias(c) for c in ("date", "close", "adjClose", "price")])
        row = F.coalesce(first, own)
        shape = F.when(first.isNotNull(), "history").otherwise("list")
        symbol = F.coalesce(blank_to_null(item["symbol"]), item["ticker"])
        return F.struct(shape.alias("shape"), symbol.alias("symbol"), row["date"].alias("date"), _price(row, "close", "adjClose", "price").alias("price"))

    return F.transform(items, quote)


def _light(rows: Column) -> Column:
    """The newest of a list of quotes without symbols, the first of equally new ones."""
    keyed = F.transform(rows, lambda r, i: F.struct(r["date"].alias("date"), (-i).alias("back"), _price(r, "price", "close", "adjClose").alias("price")))
    newest = F.array_max(keyed)
    return F.array(_entry("light", F.col("symbol"), newest["date"], newest["price"]))


def mixed_quotes(records: DataFrame, json_col: str = "json") -> DataFrame:
    """shape, symbol, price and date of every quote in `symbol, json` records.

    Shapes: charts; an object or a list of objects with a history; a list of quotes, bare or under `data`, with
    symbols (bulk), or under `historical` without (light). A record of another shape, or that is no JSON, has no quotes."""
    parsed = records.select("symbol", F.try_parse_json(F.col(json_col)).alias("v"))
    many = _at("$", f"array<{_ITEM}>")
    stocks = _at("$.historicalStockList", f"array<{_ITEM}>")
    data = _at("$.data", f"array<{_ITEM}>")
    history = _at("$.historical", f"array<struct<{_QUOTE}>>")
    own = blank_to_null(_at("$.symbol", "string"))
    first = F.get(history, F.lit(0))
    quotes = (
        F.when(many.isNotNull(), _listed(many))
        .when(stocks.isNotNull(), _listed(stocks))
        .when(own.isNotNull(), F.array(_entry("history", own, first["date"], _price(first, "close", "adjClose", "price"))))
        .when(data.isNotNull(), _listed(data))
        .when(history.isNotNull(), _light(history))
        .when(_at("$.chart", "variant").isNotNull(), _chart())
    )
    rows = parsed.select(F.inline(quotes.cast(f"array<{_ENTRY}>")))
    usable = rows.where(blank_to_null(F.col("symbol")).isNotNull() & truthy(F.col("price")))
    return usable.select("shape", normalize_symbol(F.col("symbol")).alias("symbol"), "price", "date")

"""Landed files to DataFrames and back.

Snapshot columns are read as text: what an empty or odd cell means is decided by the operators.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickersieve.config import SHARED_LIST_LABEL, WATCHLIST_SECTOR
from tickersieve.functions.numbers import blank_to_null, strip
from tickersieve.functions.symbols import normalize_symbol
from tickersieve.operators.universe import carry_forward, union_keep_first, with_sector_defaults
from tickersieve.schemas import FUND_COLUMNS, PRICE_COLUMNS, STOCK_COLUMNS, STOCK_SCHEMA
from tickersieve.sources.headers import column_or_null, find_column

log = logging.getLogger(__name__)

# Header spellings of ticker lists and of constituents imports, best first.
TICKER_ALIASES = {
    "symbol": ("symbol", "ticker", "티커"),
    "name": ("name", "company", "security", "회사명"),
    "sector": ("sector", "gics sector", "섹터"),
    "sub_industry": (
        "subindustry",
        "sub industry",
        "gics sub-industry",
        "industry",
        "세부업종",
    ),
}
IMPORT_ALIASES = {
    "symbol": ("symbol", "ticker"),
    "name": ("security", "name", "company"),
    "sector": ("gics sector", "sector"),
    "sub_industry": ("gics sub-industry", "sub industry", "industry"),
}


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header as text columns; `""` is a quote inside quotes, blank rows are dropped.

    `multi_line` allows line breaks inside quotes, but such a file cannot be split; leave it
    off for big files. Adds `ordinal`, which orders rows by file path and position in the file,
    unless the file has such a column.
    """
    df = spark.read.csv(
        path,
        header=True,
        multiLine=multi_line,
        quote='"',
        escape='"',
        inferSchema=False,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        nullValue="\0",
        emptyValue="",
        mode="PERMISSIVE",
    )
    names = df.columns
    numbered = find_column(df, "ordinal") is None
    if numbered:
        df = with_position(df, path, "_position")
    cells = [F.col(f"`{c}`") for c in names]
    clean = df.select(
        *[F.coalesce(F.translate(c, "\r", ""), F.lit("")).alias(n) for c, n in zip(cells, names)],
        *[F.col("_position").alias("ordinal")] * numbered,
    )
    filled = F.lit(False)
    for name in names:
        filled = filled | (strip(F.col(f"`{name}`")) != "")
    return clean.where(filled)


# Bits of a position that number rows within a task, and the bytes of input that share one number
# above them; no less than a file split has.
_ROW_BITS, _BLOCK_BYTES = 33, 1 << 18
_BROADCAST_FILES = 50_000


def with_position(df: DataFrame, path: str, name: str) -> DataFrame:
    """Adds a number that orders the rows of a file source by file path, place of the split in
    the file, and row; Spark itself packs files into tasks by size. Only the files' listing is
    read besides."""
    files = df.sparkSession.read.format("binaryFile").load(path)
    blocks = F.ceil(F.col("length") / _BLOCK_BYTES) + 1
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("_metadata.file_path").alias("_file"), blocks.alias("_blocks")).select(
        "_file", F.coalesce(F.sum("_blocks").over(earlier), F.lit(0)).alias("_start")
    )
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    block = F.floor(F.col("_metadata.file_block_start") / _BLOCK_BYTES)
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), block.alias("_block"), row.alias("_row"))
    position = F.shiftleft((F.col("_start") + F.col("_block")).cast("long"), _ROW_BITS) + F.col("_row")
    # One short row per file; beyond this number of files the rows are shuffled to them instead.
    if len(df.inputFiles()) <= _BROADCAST_FILES:
        starts = F.broadcast(starts)
    return placed.join(starts, "_file").withColumn(name, position).drop("_file", "_block", "_row", "_start")


def _ordinal(raw: DataFrame) -> Column:
    return column_or_null(raw, "ordinal").cast("long")


def resolve_constituents(raw: DataFrame) -> DataFrame:
    """Constituents columns to universe rows; fails without a Symbol column."""
    exact = {c.strip(): c for c in raw.columns}
    if "Symbol" not in exact:
        raise ValueError("the constituents file has no Symbol column")

    def text(name: str) -> Column:
        return F.col(f"`{exact[name]}`") if name in exact else F.lit("")

    return raw.select(
        normalize_symbol(text("Symbol")).alias("symbol"),
        text("Security").alias("name"),
        text("GICS Sector").alias("sector"),
        text("GICS Sub-Industry").alias("sub_industry"),
        _ordinal(raw).alias("ordinal"),
    ).where("symbol != ''")


def resolve_tickers(raw: DataFrame, label: str = SHARED_LIST_LABEL) -> DataFrame:
    """A ticker list under any known header to universe rows; without a symbol column, none."""
    symbol = normalize_symbol(column_or_null(raw, *TICKER_ALIASES["symbol"]))

    def text(name: str, default: Column) -> Column:
        return F.coalesce(blank_to_null(column_or_null(raw, *TICKER_ALIASES[name])), default)

    return raw.select(
        symbol.alias("symbol"),
        text("name", symbol).alias("name"),
        text("sector", F.lit(WATCHLIST_SECTOR)).alias("sector"),
        text("sub_industry", F.lit(label or SHARED_LIST_LABEL)).alias("sub_industry"),
        _ordinal(raw).alias("ordinal"),
    ).where("symbol != ''")


def read_constituents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return resolve_constituents(read_csv(spark, path, multi_line))


def read_tickers(
    spark: SparkSession, path: str, label: str = SHARED_LIST_LABEL, multi_line: bool = False
) -> DataFrame:
    """A ticker list file; a file that is missing or unreadable counts as an empty list."""
    try:
        return resolve_tickers(read_csv(spark, path, multi_line), label)
    except AnalysisException as problem:
        log.warning("could not read %s: %s", label, problem)
        return spark.createDataFrame(
            [], "symbol string, name string, sector string, sub_industry string, ordinal bigint"
        )


def resolve_import(raw: DataFrame) -> DataFrame:
    """An imported constituents table; needs symbol, name and sector under any known header."""
    for logical in ("symbol", "name", "sector"):
        if find_column(raw, *IMPORT_ALIASES[logical]) is None:
            raise ValueError("the file needs Symbol/Ticker, Security/Name and GICS Sector/Sector")
    return raw.select(
        *[column_or_null(raw, *names).alias(k) for k, names in IMPORT_ALIASES.items()],
        _ordinal(raw).alias("ordinal"),
    )


def import_constituents(raw: DataFrame, old: DataFrame) -> DataFrame:
    """Replace the universe by an imported table, keeping prices and assumptions of `old`."""
    stocks = union_keep_first(with_sector_defaults(resolve_import(raw)))
    return carry_forward(stocks, old)


def write_prices(prices: DataFrame, path: str) -> None:
    """Snapshot CSV in the fixed column order, sorted by symbol over its part files."""
    _write_csv(prices.select(*PRICE_COLUMNS).orderBy("symbol"), path)


def conform_fundamentals(rows: DataFrame) -> DataFrame:
    """The fixed fundamentals columns in order; missing ones are added empty."""
    present = set(rows.columns)
    return rows.select(
        *[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in FUND_COLUMNS]
    )


def write_fundamentals(rows: DataFrame, path: str) -> None:
    _write_csv(conform_fundamentals(rows), path)


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', nullValue="", emptyValue="", dateFormat="yyyy-MM-dd"
    )


def append_watchlist(additions: DataFrame, path: str) -> None:
    additions.write.mode("append").csv(
        path, header=True, quote='"', escape='"', nullValue="", emptyValue=""
    )


def write_stocks(stocks: DataFrame, path: str) -> None:
    """Export the stock table as JSON lines."""
    stocks.select(*STOCK_COLUMNS).write.mode("overwrite").json(path, ignoreNullFields=False)


def read_stocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STOCK_SCHEMA).json(path)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail a job whose result is empty instead of overwriting a good file with nothing."""
    if df.isEmpty():
        raise RuntimeError(f"no {what} were produced")
    return df

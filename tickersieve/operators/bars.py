"""Daily bars to one row of technical metrics per symbol.

Bars are `symbol, date, close, adj_close, volume` and optionally `ordinal`, NULL where a value
is missing. All lookbacks count valid observations of distinct days.

Plan: one exchange and one sort on (symbol, date) serve the choice of one row per day, both
windows and the final aggregate. After that choice the rows of one symbol are bounded by the
number of days in the history, so no symbol can outgrow a task.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickersieve.config import SOURCE_PRICE_JOB
from tickersieve.functions.dates import as_date
from tickersieve.functions.numbers import finite
from tickersieve.functions.symbols import normalize_symbol, to_api_symbol
from tickersieve.schemas import BAR_SCHEMA, PRICE_COLUMNS

YEAR = 252
RETURN_LOOKBACKS = {"return1m": 21, "return3m": 63, "return4m": 84, "return6m": 126}
MOVING_AVERAGES = {"ma20": 20, "ma50": 50, "ma200": 200}
SWING = 84
VOLUME_DAYS = 63


def clean_bars(bars: DataFrame) -> DataFrame:
    """NaN and infinities become gaps; a missing adj_close column means close is adjusted. An
    ordinal is kept."""
    present = set(bars.columns)
    adjusted = "adj_close" if "adj_close" in present else "close"
    volume = F.col("volume") if "volume" in present else F.lit(None)
    kept = ["ordinal"] if "ordinal" in present else []
    return bars.select(
        "symbol",
        F.col("date").cast("date").alias("date"),
        finite(F.col("close").cast("double")).alias("close"),
        finite(F.col(adjusted).cast("double")).alias("adj_close"),
        finite(volume.cast("double")).alias("volume"),
        *kept,
    )


_VALUES = ("close", "adj_close", "volume")


def _recency(columns: list[str], order_by: str) -> list[Column]:
    """What decides between rows of one day: rows with an ordinal before others, then the ordinal,
    then the values, so that the choice never depends on how rows were dealt out."""
    ties = [F.coalesce(F.col(v), F.lit(float("-inf"))) for v in _VALUES]
    if order_by not in columns:
        return ties
    return [F.col(order_by).isNotNull(), F.col(order_by), *ties]


def dedupe_bars(bars: DataFrame, order_by: str = "ordinal") -> DataFrame:
    """One row per (symbol, date): the whole row with the highest ordinal; NULL is the lowest.

    Copies combine on the map side, so a day repeated any number of times costs one row per
    map task.
    """
    newest = F.struct(*_recency(bars.columns, order_by))
    row = F.max_by(F.struct(*_VALUES), newest).alias("row")
    return bars.groupBy("symbol", "date").agg(row).select("symbol", "date", "row.*")


def last_of_day(bars: DataFrame, order_by: str = "ordinal") -> DataFrame:
    """As dedupe_bars, on the partitioning and the sort by (symbol, date) that the metrics need
    anyway. Rows stream through the window; no day is held as a whole."""
    order = [c.asc_nulls_first() for c in _recency(bars.columns, order_by)]
    by_day = Window.partitionBy("symbol").orderBy("date", *order)
    following = F.lead("date").over(by_day)
    return bars.withColumn("_next", following).where("_next is null or _next != date").drop("_next")


def within_history(
    bars: DataFrame, as_of: str | dt.date | None = None, months: int | None = None
) -> DataFrame:
    """Bars up to as_of and, if given, from that many months before; reaches the scan."""
    if as_of is not None:
        bars = bars.where(F.col("date") <= as_date(as_of))
        if months is not None:
            bars = bars.where(F.col("date") > F.add_months(as_date(as_of), -months))
    elif months is not None:
        raise ValueError("months needs as_of")
    return bars


def _numbered(bars: DataFrame) -> DataFrame:
    """Add, per row: how recent its close and its volume are, and the previous valid close."""
    by_day = Window.partitionBy("symbol").orderBy("date")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    overall = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swing_close = F.when(F.col("recency") <= SWING, F.col("close"))
    numbered = bars.select(
        "*",
        F.when(
            F.col("close").isNotNull(),
            F.count("close").over(overall) - F.count("close").over(so_far) + 1,
        ).alias("recency"),
        F.when(
            F.col("volume").isNotNull(),
            F.count("volume").over(overall) - F.count("volume").over(so_far) + 1,
        ).alias("volume_recency"),
        F.expr("lag(close) IGNORE NULLS OVER (PARTITION BY symbol ORDER BY date)").alias("previous"),
    )
    return numbered.withColumn("swing_peak", F.max(swing_close).over(so_far))


def _latest(column: str) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("date")))


def bar_metrics(bars: DataFrame) -> DataFrame:
    """All metrics, unrounded, one row per symbol that has any bar.

    Columns that a caller does not select are pruned with their windows.
    """
    per_symbol = _numbered(bars).groupBy("symbol").agg(
        F.count("close").alias("valid"),
        F.max(F.when(F.col("close").isNotNull(), F.col("date"))).alias("date"),
        _latest("close").alias("close"),
        _latest("adj_close").alias("adj_close"),
        _latest("volume").cast("long").alias("volume"),
        F.avg(F.when(F.col("volume_recency") <= VOLUME_DAYS, F.col("volume")))
        .cast("long")
        .alias("avg_volume3m"),
        *_close_figures(),
    )
    return finished_metrics(per_symbol)


def _close_figures() -> list[Column]:
    """Aggregates over rows with close, recency, previous and swing_peak."""
    close, recency = F.col("close"), F.col("recency")
    in_year = F.when(recency <= YEAR, close)
    in_swing = recency <= SWING
    step = F.when(in_swing, F.try_divide(close, F.col("previous")) - 1.0)
    broken_step = in_swing & (F.col("previous") == 0.0) & (close != 0.0)
    dip = F.when(in_swing, F.try_divide(close, F.col("swing_peak")) - 1.0)
    broken_dip = in_swing & (F.col("swing_peak") == 0.0) & (close < 0.0)
    figures = [
        F.max(in_year).alias("high52"),
        F.min(in_year).alias("low52"),
        F.stddev_samp(step).alias("step_deviation"),
        F.coalesce(F.bool_or(broken_step), F.lit(False)).alias("broken_step"),
        F.min(dip).alias("deepest_dip"),
        F.coalesce(F.bool_or(broken_dip), F.lit(False)).alias("broken_dip"),
    ]
    figures += [
        F.avg(F.when(recency <= days, close)).alias(f"mean_{name}")
        for name, days in MOVING_AVERAGES.items()
    ]
    figures += [
        F.max(F.when(recency == days + 1, close)).alias(f"past_{name}")
        for name, days in RETURN_LOOKBACKS.items()
    ]
    return figures


def _newest(bars: DataFrame, column: str, count: int) -> DataFrame:
    """symbol, date, the column and recency of the newest values of each symbol.

    Spark keeps so many rows per symbol in each map task before the exchange (window group limit)."""
    by_day = Window.partitionBy("symbol").orderBy(F.desc("date"))
    present = bars.where(F.col(column).isNotNull()).select("symbol", "date", column)
    return present.withColumn("recency", F.row_number().over(by_day)).where(F.col("recency") <= count)


def newest_metrics(bars: DataFrame) -> DataFrame:
    """As bar_metrics, for long histories of one bar per symbol and day.

    No lookback exceeds YEAR closes, so only as many per symbol and map task are shuffled, and the last
    VOLUME_DAYS volumes as a second branch; the rest of the history ends in the scan's task. Both branches end
    partitioned by symbol. `valid` counts up to YEAR closes. A table of bars is read once per branch, each with
    its own columns only; store bars that are expensive to derive first.
    """
    by_day = Window.partitionBy("symbol").orderBy(F.desc("date"))
    running = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swing_close = F.when(F.col("recency") <= SWING, F.col("close"))
    closes = _newest(bars, "close", YEAR).withColumn("previous", F.lead("close").over(by_day))
    closes = closes.withColumn("swing_peak", F.max(swing_close).over(running))
    latest = F.col("recency") == 1
    per_close = closes.groupBy("symbol").agg(
        F.count("close").alias("valid"),
        F.max(F.when(latest, F.col("date"))).alias("date"),
        F.max(F.when(latest, F.col("close"))).alias("close"),
        *_close_figures(),
    )
    per_volume = (
        _newest(bars, "volume", VOLUME_DAYS)
        .groupBy("symbol")
        .agg(F.max(F.when(latest, F.col("volume"))).cast("long").alias("volume"), F.avg("volume").cast("long").alias("avg_volume3m"))
    )
    every = bars.groupBy("symbol").agg(_latest("adj_close").alias("adj_close"))
    joined = every.join(per_close, "symbol", "left").join(per_volume, "symbol", "left")
    return finished_metrics(joined.withColumn("valid", F.coalesce("valid", F.lit(0))))


def finished_metrics(per_symbol: DataFrame) -> DataFrame:
    """The metrics of each symbol from its counts, means, extremes and earlier closes."""
    last, valid = F.col("close"), F.col("valid")
    high, low = F.col("high52"), F.col("low52")
    moving = [F.when(valid >= n, F.col(f"mean_{m}")).alias(m) for m, n in MOVING_AVERAGES.items()]
    returns = [
        F.when(F.col(f"past_{r}") > 0.0, last / F.col(f"past_{r}") - 1.0).alias(r)
        for r in RETURN_LOOKBACKS
    ]
    return per_symbol.select(
        "symbol",
        "valid",
        "date",
        "close",
        "adj_close",
        "volume",
        "avg_volume3m",
        *moving,
        F.when(
            (valid >= 25) & ~F.col("broken_step"), F.col("step_deviation") * F.sqrt(F.lit(252.0))
        ).alias("volatility4m"),
        F.when((valid >= 10) & ~F.col("broken_dip"), F.col("deepest_dip")).alias("max_drawdown4m"),
        "high52",
        "low52",
        F.when(high > low, (last - low) / (high - low)).alias("range52"),
        F.when(high > 0.0, last / high - 1.0).alias("distance52_high"),
        F.when(low > 0.0, last / low - 1.0).alias("distance52_low"),
        *returns,
    )


def eod_metrics(
    bars: DataFrame,
    updated_at: str,
    as_of: str | dt.date | None = None,
    months: int | None = None,
    source: str = SOURCE_PRICE_JOB,
    one_a_day: bool = False,
) -> DataFrame:
    """Price snapshot rows: rounded metrics of every symbol with a valid close, by symbol.

    Repeated days and spellings of a symbol count once: the row with the highest ordinal, if
    there is such a column. `one_a_day` says that there are none, which saves looking for them.
    """
    spelled = clean_bars(bars).withColumn("symbol", normalize_symbol(F.col("symbol")))
    recent = within_history(spelled.where(F.col("date").isNotNull()), as_of, months)
    return price_rows(bar_metrics(recent if one_a_day else last_of_day(recent)), updated_at, source)


def eod_metrics_long_history(
    bars: DataFrame,
    updated_at: str,
    as_of: str | dt.date | None = None,
    source: str = SOURCE_PRICE_JOB,
) -> DataFrame:
    """As eod_metrics, for a table of many years with one bar per symbol and day (see newest_metrics)."""
    spelled = clean_bars(bars).withColumn("symbol", normalize_symbol(F.col("symbol")))
    recent = within_history(spelled.where(F.col("date").isNotNull()), as_of)
    return price_rows(newest_metrics(recent), updated_at, source)


def price_rows(metrics: DataFrame, updated_at: str, source: str = SOURCE_PRICE_JOB) -> DataFrame:
    """Metrics of symbols with a valid close as rows of the price snapshot."""
    metrics = metrics.where("valid > 0")

    def rounded(name: str) -> Column:
        return F.round(F.col(name), 6)

    return metrics.select(
        normalize_symbol(F.col("symbol")).alias("symbol"),
        to_api_symbol(F.col("symbol")).alias("yahooSymbol"),
        "date",
        rounded("close").alias("close"),
        rounded("adj_close").alias("adjClose"),
        "volume",
        F.col("avg_volume3m").alias("avgVolume3m"),
        *[rounded(m).alias(m) for m in MOVING_AVERAGES],
        rounded("volatility4m").alias("volatility4m"),
        rounded("max_drawdown4m").alias("maxDrawdown4m"),
        rounded("high52").alias("high52"),
        rounded("low52").alias("low52"),
        rounded("range52").alias("range52"),
        rounded("distance52_high").alias("distance52High"),
        rounded("distance52_low").alias("distance52Low"),
        *[rounded(r).alias(r) for r in RETURN_LOOKBACKS],
        F.lit(source).alias("source"),
        F.lit(updated_at).alias("updatedAt"),
    ).select(*PRICE_COLUMNS)


def panel_to_long(
    panel: DataFrame, tickers: list[str], date_col: str = "date", separator: str = "|"
) -> DataFrame:
    """Wide panel with columns `<ticker><separator><field>` to bars, without a shuffle.

    Tickers without any column are skipped, rows whose fields are all NULL dropped.
    """
    columns = set(panel.columns)
    known = {c.split(separator, 1)[0] for c in columns if separator in c}

    def field(ticker: str, *names: str) -> Column:
        for name in names:
            if f"{ticker}{separator}{name}" in columns:
                return F.col(f"`{ticker}{separator}{name}`").cast("double")
        return F.lit(None).cast("double")

    groups = []
    for ticker in tickers:
        if ticker not in known:
            continue
        prefix = f"{ticker}{separator}"
        own = [c for c in panel.columns if c.startswith(prefix)]
        groups.append(
            F.struct(
                F.lit(ticker).alias("symbol"),
                field(ticker, "Close").alias("close"),
                field(ticker, "Adj Close", "Close").alias("adj_close"),
                field(ticker, "Volume").alias("volume"),
                reduce(or_, [F.col(f"`{c}`").isNotNull() for c in own]).alias("any"),
            )
        )
    if not groups:
        return panel.sparkSession.createDataFrame([], BAR_SCHEMA)
    return (
        panel.select(F.col(date_col).cast("date").alias("date"), F.inline(F.array(*groups)))
        .where("any")
        .select("symbol", "date", "close", "adj_close", "volume")
    )

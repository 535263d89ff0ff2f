"""The price job without its history: per symbol the newest values, into which new bars are merged.

A state row holds, newest first, up to `kept` (date, value) entries of each of closes, volumes and adjusted closes, and for
each the date of the newest entry that was cut off. So every value after that date is in the row, and a bar up to it
changes nothing that a metric looks at. New bars replace what the state has of their symbol and day, a missing value takes
it away; late and corrected bars need no history. The entries hold SLACK more than the lookbacks need; a symbol that has
lost more than these to corrections is `stale` and is rebuilt from the history, alone.

All metrics of a row follow from its arrays, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersieve.operators.bars import MOVING_AVERAGES, RETURN_LOOKBACKS, SWING, VOLUME_DAYS, YEAR, clean_bars, dedupe_bars, finished_metrics
from tickersieve.functions.symbols import normalize_symbol

SLACK = 16
NEEDED = {"close": YEAR, "volume": VOLUME_DAYS, "adj_close": 1}
_ENTRIES = "array<struct<date: date, value: double>>"


def _kept(value: str) -> int:
    return NEEDED[value] + SLACK


def _limited(entries: Column, value: str, cut: Column) -> list[Column]:
    """Sorted entries after `cut`, shortened, and the new cut."""
    extra = F.get(entries, F.lit(_kept(value)))
    shorter = F.slice(entries, 1, _kept(value)).alias(f"{value}_entries")
    return [shorter, F.greatest(cut, extra["date"]).alias(f"{value}_cut")]


def daily_bars(bars: DataFrame) -> DataFrame:
    """Clean bars, one per normal symbol and day: the one with the highest ordinal."""
    spelled = clean_bars(bars).withColumn("symbol", normalize_symbol(F.col("symbol")))
    return dedupe_bars(spelled.where(F.col("date").isNotNull()))


def initial_state(bars: DataFrame) -> DataFrame:
    """The state after a whole history."""
    daily = daily_bars(bars)
    return merge_state(daily.select("symbol").limit(0).transform(_empty), daily, deduped=True)


def _empty(symbols: DataFrame) -> DataFrame:
    columns = [c for v in NEEDED for c in (F.lit(None).cast(_ENTRIES).alias(f"{v}_entries"), F.lit(None).cast("date").alias(f"{v}_cut"))]
    return symbols.select("symbol", *columns)


def merge_state(state: DataFrame, bars: DataFrame, deduped: bool = False) -> DataFrame:
    """The state with new bars: of new days, late ones, and corrections of known days.

    The bars are shuffled, and the state if it isn't stored by symbol already; the history is not read."""
    daily = bars if deduped else daily_bars(bars)
    entry = lambda v: F.struct("date", F.col(v).alias("value"))
    lists = daily.groupBy("symbol").agg(*[F.collect_list(entry(v)).alias(f"new_{v}") for v in NEEDED])
    joined = state.join(lists, "symbol", "full_outer")
    columns = []
    for v in NEEDED:
        cut = F.col(f"{v}_cut")
        new = F.coalesce(F.col(f"new_{v}"), F.array().cast(_ENTRIES))
        old = F.coalesce(F.col(f"{v}_entries"), F.array().cast(_ENTRIES))
        days = F.transform(new, lambda e: e["date"])
        left = F.filter(old, lambda e: ~F.array_contains(days, e["date"]))
        usable = F.filter(new, lambda e: e["value"].isNotNull() & (cut.isNull() | (e["date"] > cut)))
        columns += _limited(F.sort_array(F.concat(left, usable), asc=False), v, cut)
    return joined.select("symbol", *columns)


def stale(state: DataFrame) -> DataFrame:
    """Symbols whose corrections took away more than the state can make up for."""
    short = [(F.size(f"{v}_entries") < n) & F.col(f"{v}_cut").isNotNull() for v, n in NEEDED.items()]
    return state.where(short[0] | short[1] | short[2]).select("symbol")


def rebuilt(state: DataFrame, history: DataFrame) -> DataFrame:
    """The state with stale symbols worked out anew from the history; that of the others is not shuffled."""
    old = stale(state)
    symbol = normalize_symbol(F.col("symbol"))
    own = history.withColumn("symbol", symbol).join(old, "symbol", "left_semi")
    return state.join(old, "symbol", "left_anti").unionByName(initial_state(own))


def state_metrics(state: DataFrame) -> DataFrame:
    """What bar_metrics gives for the whole history; `valid` counts the kept closes."""
    closes = F.transform("close_entries", lambda e: e["value"])
    volumes = F.transform("volume_entries", lambda e: e["value"])
    base = state.select(
        "symbol",
        closes.alias("closes"),
        F.slice(volumes, 1, VOLUME_DAYS).alias("volumes"),
        F.get("close_entries", F.lit(0))["date"].alias("date"),
        F.get("adj_close_entries", F.lit(0))["value"].alias("adj_close"),
        F.size("close_entries").alias("valid"),
    )
    n = F.least(F.col("valid") - 1, F.lit(SWING))
    later, earlier = F.slice("closes", F.lit(1), F.greatest(n, F.lit(0))), F.slice("closes", F.lit(2), F.greatest(n, F.lit(0)))
    pairs = base.withColumns({"steps": F.zip_with(later, earlier, lambda a, b: F.try_divide(a, b) - 1.0), "falls": F.zip_with(later, earlier, lambda a, b: (b == 0.0) & (a != 0.0))})
    known = pairs.withColumn("steps", F.array_compact("steps"))
    mean = _sum(F.col("steps")) / F.size("steps")
    deviation = F.when(F.size("steps") > 1, F.sqrt(_sum(F.transform("steps", lambda s: (s - mean) * (s - mean))) / (F.size("steps") - 1)))
    figures = known.select(
        "symbol",
        "valid",
        "date",
        F.get("closes", F.lit(0)).alias("close"),
        "adj_close",
        F.get("volumes", F.lit(0)).cast("long").alias("volume"),
        F.when(F.size("volumes") > 0, _sum(F.col("volumes")) / F.size("volumes")).cast("long").alias("avg_volume3m"),
        F.array_max(F.slice("closes", 1, YEAR)).alias("high52"),
        F.array_min(F.slice("closes", 1, YEAR)).alias("low52"),
        deviation.alias("step_deviation"),
        F.exists("falls", lambda x: x).alias("broken_step"),
        _dips().alias("dips"),
        *[(_sum(F.slice("closes", 1, days)) / days).alias(f"mean_{m}") for m, days in MOVING_AVERAGES.items()],
        *[F.get("closes", F.lit(days)).alias(f"past_{r}") for r, days in RETURN_LOOKBACKS.items()],
    )
    return finished_metrics(figures.withColumns({"deepest_dip": F.col("dips.deepest"), "broken_dip": F.col("dips.broken")}))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _dips() -> Column:
    """The deepest fall from the highest close so far, over the last SWING closes in order of time."""
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(None).cast("double").alias("deepest"), F.lit(False).alias("broken"))

    def step(so_far: Column, close: Column) -> Column:
        peak = F.greatest(so_far["peak"], close)
        dip = F.try_divide(close, peak) - 1.0
        broken = so_far["broken"] | ((peak == 0.0) & (close < 0.0))
        return F.struct(peak.alias("peak"), F.least(so_far["deepest"], dip).alias("deepest"), broken.alias("broken"))

    return F.aggregate(F.reverse(F.slice("closes", 1, SWING)), start, step)

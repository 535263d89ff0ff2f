"""Bar metrics against a plain pandas statement of their definitions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickersieve.operators import bars as ops
from tickersieve.schemas import BAR_SCHEMA, PRICE_COLUMNS

DAY = dt.date(2001, 1, 1)


def frame(spark, series):
    rows = []
    for symbol, values in series.items():
        for i, value in enumerate(values):
            close, adj, volume = value if isinstance(value, tuple) else (value, value, 1.0)
            rows.append((symbol, DAY + dt.timedelta(days=i), close, adj, volume))
    return spark.createDataFrame(rows, BAR_SCHEMA)


def expected(values):
    """The definitions, for one symbol, newest observation last."""
    closes = [v for v in values if v is not None]
    out = {"valid": len(closes)}
    if not closes:
        return out
    last, year, swing = closes[-1], closes[-252:], closes[-84:]
    out["high52"], out["low52"] = max(year), min(year)
    if max(year) > min(year):
        out["range52"] = (last - min(year)) / (max(year) - min(year))
    for name, back in ops.RETURN_LOOKBACKS.items():
        if len(closes) > back and closes[-1 - back] > 0:
            out[name] = last / closes[-1 - back] - 1
    for name, size in ops.MOVING_AVERAGES.items():
        if len(closes) >= size:
            out[name] = sum(closes[-size:]) / size
    recent = closes[-85:]
    if len(recent) >= 25 and all(a != 0 for a in recent[:-1]):
        steps = [b / a - 1 for a, b in zip(recent, recent[1:])]
        out["volatility4m"] = float(np.std(steps, ddof=1)) * math.sqrt(252)
    if len(swing) >= 10:
        peaks = np.maximum.accumulate(swing)
        if all(p != 0 for p in peaks):
            out["max_drawdown4m"] = float(min(np.array(swing) / peaks - 1))
    return out


LENGTHS = [1, 9, 10, 19, 20, 21, 22, 24, 25, 49, 50, 63, 64, 84, 85, 86, 126, 127, 199, 200, 251, 252, 253, 300]


def test_boundary_lengths(spark):
    rng = np.random.default_rng(7)
    series = {}
    for n in LENGTHS:
        values = [float(v) for v in rng.uniform(5, 50, n)]
        gaps = [None if rng.random() < 0.3 else 0 for _ in range(n // 2)]
        series[f"n{n}"] = [v for pair in zip(values, gaps) for v in ((pair[0], None) if pair[1] is None else (pair[0],))] + values[len(gaps):]
    series["none"] = [None, None]
    got = {r["symbol"]: r.asDict() for r in ops.bar_metrics(frame(spark, series)).collect()}
    assert set(got) == set(series)
    names = ["valid", "high52", "low52", "range52", *ops.RETURN_LOOKBACKS, *ops.MOVING_AVERAGES, "volatility4m", "max_drawdown4m"]
    for symbol, values in series.items():
        want = expected(values)
        for name in names:
            assert got[symbol][name] == (None if want.get(name) is None else pytest.approx(want[name], rel=1e-9)), (symbol, name)


def test_zero_and_negative_prices(spark):
    up = [float(i) for i in range(1, 31)]
    series = {
        "zero_prev": [*up[:10], 0.0, *up[11:]],
        "negative": [-v for v in up],
        "falling_below": [*up[:15], *[-v for v in up[15:]]],
    }
    got = {r["symbol"]: r for r in ops.bar_metrics(frame(spark, series)).collect()}
    assert got["zero_prev"]["volatility4m"] is None
    assert got["zero_prev"]["max_drawdown4m"] == -1.0
    assert got["negative"]["return1m"] is None
    for symbol in ("negative", "falling_below"):
        assert got[symbol]["max_drawdown4m"] == pytest.approx(expected(series[symbol])["max_drawdown4m"])
    assert got["negative"]["distance52_high"] is None


def test_adjusted_and_volume_end_on_their_own_days(spark):
    series = {"a": [(10.0, 9.0, 100.0), (11.0, None, 200.0), (12.0, None, None), (None, None, None)]}
    row = ops.bar_metrics(frame(spark, series)).first()
    assert (row["date"], row["close"], row["adj_close"], row["volume"]) == (DAY + dt.timedelta(days=2), 12.0, 9.0, 200)
    assert row["avg_volume3m"] == 150


def test_average_volume_truncates_and_counts_volumes(spark):
    series = {"a": [(1.0, 1.0, float(v)) for v in range(1, 71)], "b": [(1.0, 1.0, 1.0), (1.0, 1.0, 2.0)]}
    got = {r[0]: r[1] for r in ops.bar_metrics(frame(spark, series)).select("symbol", "avg_volume3m").collect()}
    assert got == {"a": sum(range(8, 71)) // 63, "b": 1}


def test_clean_bars(spark):
    raw = spark.createDataFrame([("a", DAY, float("nan")), ("a", DAY + dt.timedelta(days=1), 3.0)], "symbol string, date date, close double")
    rows = ops.clean_bars(raw).orderBy("date").collect()
    assert [(r["close"], r["adj_close"], r["volume"]) for r in rows] == [(None, None, None), (3.0, 3.0, None)]


def test_eod_metrics_shape(spark):
    series = {"brk-b": [1.0, 2.0], "none": [None]}
    out = ops.eod_metrics(frame(spark, series), "now", source="test")
    assert out.columns == list(PRICE_COLUMNS)
    row = out.collect()
    assert len(row) == 1 and (row[0]["symbol"], row[0]["yahooSymbol"]) == ("BRK.B", "BRK-B")
    assert row[0]["updatedAt"] == "now" and row[0]["source"] == "test"


def test_history_bounds(spark):
    df = frame(spark, {"a": [float(i) for i in range(60)]})
    kept = ops.within_history(df, "2001-02-10", 1)
    days = [r["date"] for r in kept.collect()]
    assert min(days) == dt.date(2001, 1, 11) and max(days) == dt.date(2001, 2, 10)
    with pytest.raises(ValueError):
        ops.within_history(df, None, 3)


def test_dedupe_and_partitioning_do_not_matter(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": rng.choice(list("abc"), 900, p=[0.8, 0.1, 0.1]), "day": rng.integers(0, 200, 900)})
    pdf["close"] = rng.uniform(1, 9, 900)
    pdf["ordinal"] = range(900)
    df = spark.createDataFrame(pdf).withColumn("date", F.date_add(F.lit(DAY), F.col("day").cast("int")))
    df = df.withColumns({"adj_close": F.col("close"), "volume": F.col("close")})
    once = ops.dedupe_bars(df)
    last = pdf.sort_values("ordinal").groupby(["symbol", "day"]).last().reset_index()
    assert once.count() == len(last)
    total = once.agg(F.sum("close")).first()[0]
    assert total == pytest.approx(last["close"].sum())
    one = ops.bar_metrics(once.repartition(1)).orderBy("symbol").collect()
    many = ops.bar_metrics(once.repartition(13)).orderBy("symbol").collect()
    assert one == many


def test_panel(spark):
    panel = spark.createDataFrame(
        [(DAY, 1.0, 5.0, None, 9.0), (DAY + dt.timedelta(days=1), None, None, 2.0, None)],
        "date date, `A|Close` double, `A|Volume` double, `B|Close` double, `B|Open` double",
    )
    rows = {(r["symbol"], r["date"].day): tuple(r)[2:] for r in ops.panel_to_long(panel, ["A", "B", "C"]).collect()}
    assert rows == {("A", 1): (1.0, 1.0, 5.0), ("B", 1): (None, None, None), ("B", 2): (2.0, 2.0, None)}
    assert ops.panel_to_long(panel, ["C"]).count() == 0

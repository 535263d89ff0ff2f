"""Metrics from pruned history, from buckets and from the merged state, against those from the whole history."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_bars import DAY, LENGTHS, frame
from tests.test_plans import no_broadcast, plan  # noqa: F401
from tickersieve.operators import bar_state
from tickersieve.operators import bars as ops
from tickersieve.schemas import BAR_SCHEMA
from tickersieve.sources import bars_store


def series(seed, lengths=LENGTHS):
    pick = random.Random(seed)
    out = {}
    for n in lengths:
        values = [round(pick.uniform(-2, 50), 3) if pick.random() < 0.97 else 0.0 for _ in range(n)]
        gap = lambda v: v if pick.random() < 0.8 else None
        out[f"N{n}"] = [(gap(v), gap(v * 0.9), gap(float(pick.randrange(1000)))) for v in values]
    out["NONE"] = [(None, None, None)] * 3
    out["VOLUME"] = [(None, 2.0, 7.0)] * 70
    return out


def rows(df, cap=None):
    out = {}
    for r in df.collect():
        values = r.asDict()
        symbol = values.pop("symbol")
        values["valid"] = values["valid"] if cap is None else min(values["valid"], cap)
        out[symbol] = {k: float(f"{v:.9g}") if isinstance(v, float) else v for k, v in values.items()}
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for symbol, x in a.items():
        for name, v in x.items():
            w = b[symbol][name]
            assert (v is None) == (w is None) and (v is None or v == w or math.isclose(v, w, rel_tol=1e-7, abs_tol=1e-9)), (symbol, name, v, w)


def test_newest_values_suffice(spark):
    bars = frame(spark, series(1))
    same(rows(ops.newest_metrics(bars)), rows(ops.bar_metrics(bars), ops.YEAR))


def test_state_of_a_whole_history(spark):
    bars = frame(spark, series(2))
    found = rows(bar_state.state_metrics(bar_state.initial_state(bars)), ops.YEAR)
    same(found, rows(ops.bar_metrics(bars), ops.YEAR))
    assert bar_state.stale(bar_state.initial_state(bars)).isEmpty()


@pytest.mark.parametrize("seed", [3, 4])
def test_merged_deliveries_equal_a_recompute(spark, seed):
    """Bars arrive in any order, some wrong at first, some taken back."""
    pick = random.Random(seed)
    full = [r for r in frame(spark, series(seed, [1, 5, 60, 64, 90, 260, 275, 300])).collect()]
    deliveries = [[] for _ in range(4)]
    for symbol, day, close, adj, volume in full:
        first = pick.randrange(4)
        if pick.random() < 0.05 and first < 3:
            deliveries[first].append((symbol, day, 99.0, None, 5.0))
            first = pick.randrange(first + 1, 4)
        deliveries[first].append((symbol, day, close, adj, volume))
    state = bar_state.initial_state(spark.createDataFrame(deliveries[0], BAR_SCHEMA))
    for batch in deliveries[1:]:
        state = bars_store.write_by_symbol(bar_state.merge_state(state, spark.createDataFrame(batch, BAR_SCHEMA)), "state", 3)
    bars = spark.createDataFrame(full, BAR_SCHEMA)
    same(rows(bar_state.state_metrics(bar_state.rebuilt(state, bars)), ops.YEAR), rows(ops.bar_metrics(bars), ops.YEAR))


def test_lost_values_make_a_symbol_stale(spark):
    bars = frame(spark, {"A": [float(i) for i in range(1, 400)], "B": [float(i) for i in range(1, 100)]})
    state = bar_state.initial_state(bars)
    recent = bars.where(F.col("date") > DAY + dt.timedelta(days=399 - 40))
    gone = recent.withColumns({c: F.lit(None).cast("double") for c in ("close", "adj_close")})
    merged = bar_state.merge_state(state, gone)
    assert [r.symbol for r in bar_state.stale(merged).collect()] == ["A"]
    history = bars.where(F.col("date") <= DAY + dt.timedelta(days=399 - 40)).unionByName(gone)
    same(rows(bar_state.state_metrics(bar_state.rebuilt(merged, history)), ops.YEAR), rows(ops.bar_metrics(history), ops.YEAR))


def test_a_bar_from_before_the_cut_changes_nothing(spark):
    bars = frame(spark, {"A": [float(i) for i in range(1, 400)]})
    state = bar_state.initial_state(bars)
    early = spark.createDataFrame([(" a ", DAY, 1e9, 1e9, 1e9), ("A", DAY - dt.timedelta(days=9), 2.0, 2.0, 2.0)], BAR_SCHEMA)
    assert bar_state.merge_state(state, early).collect() == state.collect()


def test_repeated_days_of_a_delivery(spark):
    batch = spark.createDataFrame([("A", DAY, 1.0, 1.0, 1.0, 1), ("a", DAY, 2.0, 2.0, 2.0, 2)], "symbol string, date date, close double, adj_close double, volume double, ordinal long")
    row = bar_state.state_metrics(bar_state.initial_state(batch)).first()
    assert (row["symbol"], row["close"], row["valid"]) == ("A", 2.0, 1)
    assert bar_state.initial_state(batch.limit(0)).isEmpty()


def nodes(df):
    """All nodes of the plan that ran."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        found.append(node)
        children = node.children()
        left += [children.apply(i) for i in range(children.length())]
    return found


def test_history_is_pruned_below_the_exchange(spark, no_broadcast, tmp_path):  # noqa: F811
    days = 900
    bars = spark.range(5 * days).select(
        F.concat(F.lit("S"), F.col("id") % 5).alias("symbol"), F.date_add(F.lit(DAY), (F.col("id") / 5).cast("int")).alias("date"),
        F.rand(1).alias("close"), F.rand(2).alias("adj_close"), F.rand(3).alias("volume"),
    )
    bars.repartition(3).write.parquet(str(tmp_path / "bars"))
    df = ops.newest_metrics(spark.read.parquet(str(tmp_path / "bars")))
    text = plan(df)
    assert len(re.findall(r"WindowGroupLimit \[symbol#\d+\], \[date#\d+ DESC NULLS LAST\], row_number\(\), 252, Partial", text)) == 1
    assert len(re.findall(r"WindowGroupLimit .* 252, Final", text)) == 1
    assert len(re.findall(r"WindowGroupLimit .* 63, Partial", text)) == len(re.findall(r"WindowGroupLimit .* 63, Final", text)) == 1
    assert "ReadSchema: struct<symbol:string,date:date,close:double>" in text
    assert text.count("Exchange hashpartitioning(symbol") == text.count("Exchange ") == 3
    assert len(df.collect()) == 5
    tasks = spark.read.parquet(str(tmp_path / "bars")).rdd.getNumPartitions()
    limits = {0: 252, 1: 63, 2: 1}
    df._jdf.queryExecution().executedPlan().executeCollect()
    sent = sorted((n.metrics().apply("shuffleRecordsWritten").value() for n in nodes(df) if n.nodeName() == "Exchange"), reverse=True)
    assert len(sent) == 3 and all(0 < s <= limits[k] * 5 * tasks for k, s in enumerate(sent))


def test_a_bucketed_store_needs_no_exchange(spark, sf_dir, no_broadcast):  # noqa: F811
    from tickersieve.plans import bindings as B

    bars = bars_store.write_bars(B.bars_short(spark, sf_dir), "bars", 4)
    text = plan(ops.price_rows(ops.bar_metrics(bars), "now"))
    assert "Exchange" not in text and "Bucketed: true" in text
    state = bars_store.write_by_symbol(bar_state.initial_state(bars), "state", 4)
    assert "Exchange" not in plan(bar_state.state_metrics(state))
    merged = plan(bar_state.merge_state(state, bars, deduped=True))
    assert "Exchange" not in merged

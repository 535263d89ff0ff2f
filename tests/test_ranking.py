"""Exact ranks, medians and percentiles against brute force on awkward value sets."""

import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickersieve.operators.peers import with_peer_stats
from tickersieve.operators.ranking import BinOffsets, median_of, value_counts

rng = np.random.default_rng(11)
VALUE_SETS = {
    "ties": [3.0] * 50 + [1.0, 2.0, 3.5],
    "one_bin": [15.0 + i * 1e-9 for i in range(40)] + [15.0] * 20,
    "one_fine_bin": [15.0 + i * 2e-15 for i in range(30)],
    "wide": [float(x) for x in 10.0 ** rng.uniform(-12, 12, 60)],
    "signed": [float(x) for x in rng.normal(0, 100, 61)] + [0.0, -0.0],
    "tiny": [0.0, 1e-300, -1e-300, 5e-324],
    "single": [2.5],
}


def rows(spark, groups):
    data = [(g, v) for g, values in groups.items() for v in values]
    data += [(g, None) for g in groups]
    return spark.createDataFrame(data, "g string, v double").repartition(5)


def test_medians(spark):
    df = rows(spark, VALUE_SETS)
    got = {r["g"]: r["median"] for r in median_of(df, "g", "v").collect()}
    for name, values in VALUE_SETS.items():
        ordered = sorted(values)
        middle = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
        assert got[name] == middle == statistics.median(values), name


def test_cumulative_counts(spark):
    counts = value_counts(rows(spark, VALUE_SETS), "g", "v")
    offsets = BinOffsets(counts, "g")
    for r in offsets.ranked(offsets.bins(), "v").collect():
        values = VALUE_SETS[r["g"]]
        assert r["upto"] == sum(x <= r["v"] for x in values)
        assert r["n"] == sum(x == r["v"] for x in values)
        assert r["total"] == len(values)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e9, 1e9, allow_subnormal=False), min_size=1, max_size=40))
def test_median_of_anything(spark, values):
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    assert median_of(df, "g", "v").first()["median"] == pytest.approx(statistics.median(values), rel=1e-15, abs=0)


def stock_rows():
    out = []
    for i in range(240):
        sector = "hot" if i % 3 else f"s{i % 5}"
        price = None if i % 17 == 0 else (30.0 if i % 2 else float(rng.uniform(1, 900)))
        eps = [2.0, 0.0, -1.0, None, 1.0][i % 5] if i % 4 == 0 else 2.0
        out.append((f"S{i}", sector, price, eps))
    out += [("NEG", "hot", -10.0, 2.0), ("BIG", "hot", 5000.0, 2.0), ("EDGE", "hot", 1000.0, 2.0)]
    out += [("TWO1", "two", 5.0, 1.0), ("TWO2", "two", 6.0, 1.0), ("BLANK", None, 6.0, 1.0)]
    return out


def brute(stock, peers):
    def pe(s):
        return s[2] / s[3] if s[2] and s[3] and s[3] > 0 else None

    own = pe(stock)
    everyone = [pe(p) for p in peers if pe(p) is not None]
    if own is None:
        return None, None, None
    near = [x for x in everyone if 0 < x < 500]
    percentile = sum(x <= own for x in near) / len(near) if len(near) >= 3 else None
    return own, statistics.median(everyone) if everyone else None, percentile


@pytest.mark.parametrize("peer_by", [None, "sector"])
def test_peer_stats(spark, peer_by):
    data = stock_rows()
    df = spark.createDataFrame(data, "symbol string, sector string, price double, forward_eps double").repartition(7)
    out = with_peer_stats(df, peer_by=peer_by)
    got = {r["symbol"]: (r["current_pe"], r["median_pe"], r["pe_percentile"]) for r in out.collect()}
    assert len(got) == len(data)
    for s in data:
        peers = data if peer_by is None else [p for p in data if (p[1] or "") == (s[1] or "")]
        assert got[s[0]] == pytest.approx(brute(s, peers)), s


def test_other_peers(spark):
    data = stock_rows()
    schema = "symbol string, sector string, price double, forward_eps double"
    peers = [p for p in data if p[1] == "hot"]
    shown = [s for s in data if s[1] != "hot"] + data[:9]
    out = with_peer_stats(spark.createDataFrame(shown, schema), spark.createDataFrame(peers, schema))
    got = {r["symbol"]: (r["current_pe"], r["median_pe"], r["pe_percentile"]) for r in out.collect()}
    for s in shown:
        assert got[s[0]] == pytest.approx(brute(s, peers)), s


def test_percentile_is_monotone_and_bounded(spark):
    df = spark.createDataFrame(stock_rows(), "symbol string, sector string, price double, forward_eps double")
    ranked = with_peer_stats(df).where("pe_percentile is not null").orderBy("current_pe")
    values = [r["pe_percentile"] for r in ranked.collect()]
    assert values == sorted(values) and min(values) >= 0 and max(values) <= 1


def test_no_peers(spark):
    df = spark.createDataFrame([("A", "x", None, None)], "symbol string, sector string, price double, forward_eps double")
    row = with_peer_stats(df).first()
    assert (row["current_pe"], row["median_pe"], row["pe_percentile"]) == (None, None, None)
    assert with_peer_stats(df.where(F.lit(False))).count() == 0

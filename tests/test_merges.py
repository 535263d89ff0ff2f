"""Universe, snapshots, feeds and files: order-dependent rules and odd inputs."""

import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tickersieve.config import ScreenConfig
from tickersieve.operators import feeds, snapshots, universe
from tickersieve.plans import jobs, views
from tickersieve.schemas import FUND_COLUMNS, STOCK_COLUMNS
from tickersieve.sources import files
from tickersieve.sources.store import shared_dir, store

CFG = ScreenConfig()
ROW = "symbol string, name string, sector string, sub_industry string, ordinal long"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def by_symbol(df):
    return {r["symbol"]: r for r in df.collect()}


def test_keep_first(spark):
    one = raw(spark, ("b-x", "first", "E", "", 5), (" B.X ", "later", "E", "", 9), ("", "blank", "E", "", 1), ("a", "a", "E", "", 2))
    two = raw(spark, ("B.X", "second", "E", "", 0), ("c", "c", "E", "", 0))
    merged = universe.union_keep_first(one, two)
    assert [(r["symbol"], r["name"]) for r in merged.orderBy("ordinal").collect()] == [("A", "a"), ("B.X", "first"), ("C", "c")]
    again = universe.union_keep_first(merged)
    assert merged.exceptAll(again).count() == 0 and again.count() == 3


def test_sector_defaults(spark):
    rows = raw(spark, ("a", "", "Energy", "", 1), ("b", "B", "", None, 2), ("c", "C", "Odd", "s", 3))
    got = by_symbol(universe.with_sector_defaults(rows))
    assert got["A"]["exit_pe"] == 10 and got["A"]["name"] == "a" and got["A"]["risk"]["cyc"] == 4.4
    assert got["B"]["sector"] == "Other" and got["B"]["exit_pe"] == 19 and got["B"]["sub_industry"] == ""
    assert got["C"]["sector"] == "Odd" and got["C"]["risk"]["reg"] == 2.6
    assert list(universe.with_sector_defaults(rows).columns) == STOCK_COLUMNS


def test_refresh_order_and_flags(spark):
    first = universe.refresh_universe(raw(spark, ("a", "A", "Energy", "", 0)), raw(spark, ("w", "", "", "", 0), ("a", "", "", "", 1)))
    got = by_symbol(first)
    assert set(got) == {"A", "W"} and got["A"]["is_custom"] is None and got["W"]["is_custom"] is True
    assert (got["W"]["name"], got["W"]["sector"], got["W"]["sub_industry"], got["W"]["exit_pe"]) == ("W", "Watchlist", "관심종목", 18)
    old = store(first.withColumns({"price": F.lit(7.0), "high52": F.lit(9.0), "eps_growth": F.lit(1.0)}), "old")
    second = universe.refresh_universe(raw(spark, ("b", "B", "Energy", "", 0), ("a", "A2", "Materials", "", 1)), raw(spark, ("v", "", "Other", "", 0), ("w", "new", "", "", 1)), old)
    rows = second.orderBy("ordinal").collect()
    assert [r["symbol"] for r in rows] == ["B", "A", "W", "V"]
    b, a, w, v = rows
    assert b["price"] is None and b["eps_growth"] == 3
    assert (a["price"], a["high52"], a["eps_growth"], a["name"], a["is_custom"]) == (7.0, None, 1.0, "A2", False)
    assert (w["price"], w["high52"], w["name"], w["is_custom"]) == (7.0, 9.0, "W", True)
    assert (v["sector"], v["exit_pe"], v["is_custom"]) == ("Watchlist", 19, True)


def test_sync_only_adds(spark):
    old = store(universe.refresh_universe(raw(spark, ("a", "A", "Energy", "", 0)), raw(spark)), "old")
    synced = universe.sync_watchlist(old, raw(spark, ("a", "changed", "", "", 0), ("n-1", "", "", "", 1), ("N.1", "dup", "", "", 2)))
    rows = synced.orderBy("ordinal").collect()
    assert [(r["symbol"], r["name"]) for r in rows] == [("A", "A"), ("N.1", "N.1")]
    assert universe.sync_watchlist(store(synced, "s"), raw(spark, ("N.1", "", "", "", 0))).count() == 2


def stocks_of(spark, *symbols):
    return universe.with_sector_defaults(raw(spark, *[(s, s, "Energy", "", i) for i, s in enumerate(symbols)]))


def texts(spark, names, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` string" for n in names))


def test_price_snapshot_rules(spark):
    snap = texts(
        spark, ["Symbol", "CLOSE", "AdjClose", "date", "return1m", "ordinal"],
        ("a", "5", "4", "d1", "0.1", "1"), ("A", "6", "", "d2", "", "2"), ("b", "", "4", "", "x", "3"),
        ("c", "0", "4", "", "", "4"), ("d", "12%", "4", "", "", "5"), ("e", "", "", "", "", "6"), ("A", "-1", "", "d3", "", "7"),
    )
    merged = by_symbol(snapshots.merge_prices(stocks_of(spark, "a", "b", "c", "d", "e"), snapshots.resolve_price_snapshot(snap)))
    assert (merged["A"]["price"], merged["A"]["price_source"], merged["A"]["return1m"]) == (6.0, "Yahoo EOD via GitHub Actions d2", None)
    assert (merged["B"]["price"], merged["B"]["price_source"]) == (4.0, "Yahoo EOD via GitHub Actions")
    assert [merged[s]["price"] for s in "CDE"] == [None] * 3
    zero = snapshots.resolve_price_snapshot(snap, replace(CFG, blank_numeric="zero"))
    assert by_symbol(snapshots.merge_prices(stocks_of(spark, "a"), zero))["A"]["return1m"] == 0.0
    with pytest.raises(ValueError):
        snapshots.resolve_price_snapshot(snap.drop("CLOSE", "AdjClose"))
    with pytest.raises(ValueError):
        snapshots.resolve_fund_snapshot(snap.drop("Symbol"))


def test_fundamentals_rules(spark):
    names = ["symbol", "forward_eps", "trailingEPS", "forwardPe", "epsGrowth", "operating_margin", "debtToEquity", "beta", "earningsDate", "earningsTimestamp", "updatedAt", "ordinal"]
    snap = texts(
        spark, names,
        ("a", "-1", "3", "130", "0.2", "", "", "", "2001-12-01T00:00", "", "t", "1"),
        ("b", "", "", "20", "", "0.25", "250", "2", "", "1004832000", "", "2"),
        ("c", "", "", "", "", "", "", "", "", "", "", "3"),
    )
    base = stocks_of(spark, "a", "b", "c", "d")
    resolved = snapshots.resolve_fund_snapshot(snap)
    got = by_symbol(snapshots.fundamental_updates(base, resolved, CFG))
    a, b, c, d = (got[s] for s in "ABCD")
    assert (a["forward_eps"], a["exit_pe"], a["eps_growth"]) == (3.0, 10.0, 20.0)
    assert a["next_earnings_date"] == dt.date(2001, 12, 1) and a["risk"]["crowding"] == 4.8
    assert a["fundamental_source"] == "Yahoo fundamentals via GitHub Actions t" and a["fundamental_auto"]
    assert (b["exit_pe"], b["op_margin"], b["next_earnings_date"]) == (20.0, 25.0, dt.date(2001, 11, 4))
    assert (b["risk"]["balance"], b["risk"]["cyc"], b["risk"]["margin"], b["risk"]["rate"]) == (4.2, 3.9, 2.5, 2.8)
    assert (c["matched"], c["touched"], c["fundamental_auto"]) == (True, False, False)
    assert (d["matched"], d["fundamental_source"]) == (False, "섹터 기본값")
    counts = snapshots.merge_counts(snapshots.fundamental_updates(base, resolved, CFG)).first()
    assert tuple(counts) == (3, 2, 2)
    zero = by_symbol(snapshots.merge_fundamentals(base, resolved, replace(CFG, blank_numeric="zero")))
    assert (zero["C"]["eps_growth"], zero["C"]["op_margin"], zero["C"]["risk"]["balance"], zero["C"]["risk"]["margin"]) == (0.0, 0.0, 1.7, 4.7)
    once = snapshots.merge_fundamentals(base, resolved, CFG)
    assert once.exceptAll(snapshots.merge_fundamentals(once, resolved, CFG)).count() == 0
    fill = by_symbol(snapshots.merge_fundamentals(once.withColumn("exit_pe", F.lit(None).cast("double")), resolved, CFG, overwrite=False))
    assert (fill["B"]["exit_pe"], fill["A"]["eps_growth"]) == (20.0, 20.0)


def test_overrides(spark):
    edits = spark.createDataFrame(
        [("a", "price", "1", 1), ("a", "price", "2.5x", 2), ("b", "epsGrowth", "", 1), ("c", "risk.cyc", "4", 1), ("a", "epsGrowth", "9", 1), ("a", "epsGrowth", None, 2)],
        "symbol string, field string, value string, ordinal int",
    )
    base = stocks_of(spark, "a", "b", "c").withColumn("fundamental_auto", F.lit(True))
    got = by_symbol(snapshots.apply_overrides(base, edits))
    assert (got["A"]["price"], got["A"]["price_source"], got["A"]["eps_growth"]) == (2.5, "manual", None)
    assert (got["B"]["eps_growth"], got["B"]["fundamental_manual"], got["B"]["fundamental_auto"], got["B"]["fundamental_source"]) == (None, True, False, "수동 입력")
    assert (got["C"]["risk"]["cyc"], got["C"]["fundamental_auto"], got["C"]["fundamental_manual"]) == (4.0, True, False)


def test_chart_records(spark):
    def chart(closes, times, error=None, result=True):
        one = {"timestamp": times, "indicators": {"quote": [{"close": closes}]}}
        return json.dumps({"chart": {"result": [one] if result else None, "error": error}})

    records = [
        ("a", chart([1.0, 2.0, None], [86400, 172800, 259200])), ("b", chart([None], [1])), ("c", chart([], [], {"code": "X", "description": ""})),
        ("d", chart([], [], result=False)), ("e", chart([1.0, 5.0], [86400])), ("f", "not json"),
    ]
    got = by_symbol(feeds.chart_last_close(spark.createDataFrame(records, "symbol string, json string")))
    assert (got["A"]["price"], got["A"]["date"]) == (2.0, dt.date(1970, 1, 3))
    assert [got[s]["error"] for s in "BCDF"] == ["no valid close", "X", "empty result", "empty result"]
    assert (got["E"]["price"], got["E"]["date"], got["E"]["error"]) == (5.0, None, None)


def test_price_api_shapes(spark):
    texts_ = [
        {"historicalStockList": [{"symbol": "a-1", "historical": [{"date": "d", "close": 1.0}]}, {"symbol": "x", "historical": []}, {"historical": [{"close": 3}]}]},
        {"symbol": "b", "historical": [{"date": "d", "adjClose": 2.0}, {"date": "e", "close": 9.0}]},
        [{"ticker": "c", "date": "d", "price": 3.0}, {"symbol": "z", "close": 0}, {"symbol": "e", "historical": [{"date": "h", "close": 4}]}],
        {"Error Message": "limit"},
    ]
    df = spark.createDataFrame([(json.dumps(t),) for t in texts_], "json string")
    got = {r["symbol"]: (r["price"], r["date"]) for r in feeds.price_api_latest(df).collect()}
    assert got == {"A.1": (1.0, "d"), "B": (2.0, "d"), "C": (3.0, "d"), "E": (4.0, "h")}


def test_bulk_waterfall_candidates(spark):
    day = dt.date(2001, 11, 5)
    quotes = spark.createDataFrame(
        [("x", day, 1.0, None, None), ("a", day - dt.timedelta(days=1), 2.0, None, None), ("a", day - dt.timedelta(days=3), None, 3.0, None),
         ("b", day - dt.timedelta(days=3), None, None, 0.0), ("a", day - dt.timedelta(days=4), 9.0, None, None)],
        "symbol string, date date, close double, adj_close double, price double",
    )
    wanted = spark.createDataFrame([("A",), ("B",)], "symbol string")
    assert [tuple(r) for r in feeds.bulk_latest_date(quotes, wanted, day).collect()] == [("A", 3.0, day - dt.timedelta(days=3))]
    feed = lambda *rows: spark.createDataFrame(list(rows), "symbol string, price double, date date")
    chosen = feeds.price_waterfall(wanted, feed(("x", 1.0, day), ("a", 0.0, day)), feed(("b", 2.0, day)), feed(("a", 3.0, day)))
    assert [(r["symbol"], r["price"], r["feed"]) for r in chosen.collect()] == [("B", 2.0, 1)]
    options = spark.createDataFrame(
        [("a", 0, None, day, ""), ("a", 1, 5.0, day, None), ("b", 0, 1.0, day, "HTTP"), ("b", 2, 3.0, day, ""), ("c", 0, None, day, "")],
        "symbol string, rank int, price double, date date, error string",
    )
    assert {r["symbol"]: (r["price"], r["rank"]) for r in feeds.price_candidates(options).collect()} == {"A": (5.0, 1), "B": (3.0, 2)}


def test_info_records(spark):
    records = [
        ("a-b", json.dumps({"shortName": "", "longName": "Long", "beta": "1.5", "earningsTimestamp": None, "earningsTimestampEnd": 86400, "pegRatio": 0}), None),
        ("b", '{"beta": NaN, "marketCap": 3000000000, "earningsTimestampStart": 0, "earningsTimestampEnd": 86400}', ""),
        ("c", '{"beta": 1}', "x" * 300),
    ]
    got = by_symbol(feeds.info_to_fundamentals(spark.createDataFrame(records, "symbol string, json string, error string"), "t"))
    assert (got["A.B"]["shortName"], got["A.B"]["beta"], got["A.B"]["pegRatio"], got["A.B"]["nextEarningsDate"]) == ("Long", 1.5, 0.0, dt.date(1970, 1, 2))
    assert (got["B"]["beta"], got["B"]["marketCap"], got["B"]["earningsTimestamp"], got["B"]["nextEarningsDate"]) == (None, 3e9, 0.0, None)
    assert (len(got["C"]["error"]), got["C"]["beta"]) == (220, None)


def test_coverage(spark):
    bars = spark.createDataFrame([("a", 1.0, 1.0), ("b", None, 2.0), ("c", None, None)], "symbol string, close double, volume double")
    wanted = spark.createDataFrame([("A",), ("b",), ("c",), ("d",)], "symbol string")
    gaps = lambda df: {r[0]: r[1] for r in universe.coverage_gaps(wanted, df).collect()}
    assert gaps(bars) == {"B": "no valid close", "C": "no usable price", "D": "no usable price"}
    assert gaps(bars.drop("close")) == {"A": "no Close column", "B": "no Close column", "C": "no usable price", "D": "no usable price"}


def test_csv_dialect(spark, tmp_path):
    file = tmp_path / "list.csv"
    file.write_bytes('﻿티커,Company,섹터\r\nA-1,"x, ""y""\nz",Energy\r\n\r\n , ,\r\nB,,\r\nC\r\n'.encode())
    got = by_symbol(files.read_tickers(spark, str(file), "mine", multi_line=True))
    assert set(got) == {"A.1", "B", "C"}
    assert (got["A.1"]["name"], got["A.1"]["sector"], got["A.1"]["sub_industry"]) == ('x, "y"\nz', "Energy", "mine")
    assert (got["B"]["name"], got["B"]["sector"]) == ("B", "Watchlist")
    assert files.read_tickers(spark, str(tmp_path / "missing.csv")).count() == 0
    (tmp_path / "odd.csv").write_text("name,price\nx,1\n")
    assert files.read_tickers(spark, str(tmp_path / "odd.csv")).count() == 0
    (tmp_path / "header.csv").write_text("symbol,name\n")
    assert files.read_tickers(spark, str(tmp_path / "header.csv")).count() == 0
    with pytest.raises(ValueError):
        files.read_constituents(spark, str(tmp_path / "odd.csv"))
    with pytest.raises(ValueError):
        files.resolve_import(files.read_csv(spark, str(tmp_path / "odd.csv")))


def test_job_files(spark, tmp_path):
    rows = [("b-1", dt.date(2001, 1, d), float(d), None, None) for d in range(1, 4)] + [("a", dt.date(2001, 1, 1), 2.0, 2.0, 7.0), ("x", dt.date(2001, 1, 1), 1.0, 1.0, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double, adj_close double, volume double")
    wanted = spark.createDataFrame([("A",), ("B.1",)], "symbol string")
    path = str(tmp_path / "prices")
    jobs.price_job(bars, wanted, path, "now", "2001-02-01")
    back = files.read_csv(spark, path)
    assert sorted(r["symbol"] for r in back.collect()) == ["A", "B.1"]
    assert by_symbol(back)["B.1"]["adjClose"] == "" and by_symbol(back)["A"]["date"] == "2001-01-01"
    with pytest.raises(RuntimeError):
        jobs.price_job(bars, wanted.where("symbol = 'none'"), path, "now", "2001-02-01")
    assert files.read_csv(spark, path).count() == 2
    info = spark.createDataFrame([("a", '{"forwardEps": 2}')], "symbol string, json string")
    jobs.fundamentals_job(info, str(tmp_path / "fund"), "now")
    fund = files.read_csv(spark, str(tmp_path / "fund"))
    assert fund.columns[: len(FUND_COLUMNS)] == list(FUND_COLUMNS) and by_symbol(fund)["A"]["forwardEps"] == "2.0"
    added = universe.watchlist_additions(raw(spark, ("n", "", "", "", 1)), raw(spark), "t", "s")
    files.append_watchlist(added, str(tmp_path / "shared"))
    files.append_watchlist(added.withColumn("symbol", F.lit("M")), str(tmp_path / "shared"))
    assert {r["symbol"] for r in files.read_tickers(spark, str(tmp_path / "shared")).collect()} == {"N", "M"}


def test_stock_json(spark, tmp_path):
    stocks = stocks_of(spark, "a", "b").withColumn("next_earnings_date", F.lit(dt.date(2001, 1, 2)))
    files.write_stocks(stocks, str(tmp_path / "s"))
    assert stocks.exceptAll(files.read_stocks(spark, str(tmp_path / "s"))).count() == 0


def test_views_on_empty_and_tied_stocks(spark):
    stocks = store(stocks_of(spark, "b", "a", "c"), "tied")
    top = [r["symbol"] for r in views.todays_picks(stocks, CFG, "2001-11-04").collect()]
    assert top == ["A", "B", "C"]
    back = [r["symbol"] for r in views.extremes_top(stocks, replace(CFG, sort_descending=True), "2001-11-04").collect()]
    assert back == ["C", "B", "A"]
    by_pe = views.sorted_screen(stocks, replace(CFG, sort_key="currentPE"), "2001-11-04")
    assert [r["symbol"] for r in by_pe.collect()] == ["B", "A", "C"]
    empty = stocks.where("symbol = 'none'")
    cards = views.summary_cards(empty, CFG, "2001-11-04").first()
    assert (cards["n"], cards["median_pe"], cards["top_symbol"]) == (0, None, None)
    assert views.sector_heatmap(empty, CFG, "2001-11-04").count() == 0
    assert views.sector_counts(stocks).orderBy("position", "sector").first()["n"] == 3


def test_locale_sort(spark):
    stocks = store(stocks_of(spark, "b", "a").withColumn("name", F.when(F.col("symbol") == "A", "zeta").otherwise("Éclair")), "names")
    order = views.sorted_screen(stocks, replace(CFG, sort_key="name"), "2001-11-04")
    assert [r["name"] for r in order.collect()] == ["Éclair", "zeta"]


class FakeSession:
    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master
        self.applicationId = f"fake-{master}"


def test_shared_dir():
    assert shared_dir(FakeSession("hdfs://x/shared/", "yarn")) == "hdfs://x/shared"
    own = shared_dir(FakeSession(None, "local[2]"))
    assert own.startswith("/tmp/spark-") and shared_dir(FakeSession(None, "local[2]")) == own
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession(None, "yarn"))

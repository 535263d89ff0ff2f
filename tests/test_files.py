"""Row order of files, saved states, and numbers beyond what usual data holds."""

import json
from dataclasses import replace

from pyspark.sql import functions as F

from tickersieve.config import RiskWeights, ScreenConfig
from tickersieve.functions.numbers import parse_loose, parse_prefix, parse_strict
from tickersieve.operators.bars import clean_bars, dedupe_bars, eod_metrics
from tickersieve.operators.rows import first_per_key, last_per_key
from tickersieve.operators.universe import refresh_universe, stacked, union_keep_first
from tickersieve.plans.views import column_name
from tickersieve.sources import files, state


def test_row_order_does_not_depend_on_file_sizes(spark, tmp_path):
    for name, rows in (("a.csv", 3), ("b.csv", 5), ("c.csv", 400)):
        (tmp_path / name).write_text("k,file,n\n" + "".join(f"S{n},{name},{n}\n" for n in range(rows)))
    df = files.read_csv(spark, str(tmp_path))
    order = [(r.file, int(r.n)) for r in df.orderBy("ordinal").collect()]
    assert order == [(f, n) for f, rows in (("a.csv", 3), ("b.csv", 5), ("c.csv", 400)) for n in range(rows)]
    assert last_per_key(df.where("k = 'S0'"), "k").first().file == "c.csv"
    assert first_per_key(df.where("k = 'S0'"), "k").first().file == "a.csv"


def test_row_order_within_a_split_file(spark, tmp_path):
    (tmp_path / "long.csv").write_text("k\n" + "".join(f"{n:08d}\n" for n in range(400_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = files.read_csv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 2
        ordered = df.orderBy("ordinal").select(F.col("k").cast("long").alias("k"), F.monotonically_increasing_id().alias("i"))
        kept = ordered.collect()
        assert [r.k for r in kept] == list(range(400_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sources_stay_in_order_however_large_their_ordinals(spark):
    kind = "symbol string, name string, sector string, sub_industry string, ordinal long"
    big = 10**17
    first = spark.createDataFrame([("A", "1", "", "", big), ("B", "1", "", "", big + 7)], kind)
    second = spark.createDataFrame([("C", "2", "", "", 3), ("A", "2", "", "", 1), ("D", "2", "", "", None)], kind)
    third = spark.createDataFrame([("E", "3", "", "", -5)], kind)
    rows = {r.symbol: r for r in union_keep_first(first, second, third).collect()}
    assert sorted((r for r in rows if rows[r].ordinal is not None), key=lambda r: rows[r].ordinal) == ["A", "B", "C", "E"]
    assert rows["A"].name == "1" and rows["D"].ordinal is None
    assert stacked(first.limit(0), second).where("symbol = 'A'").first().ordinal == 0
    stocks = refresh_universe(first, second).orderBy("ordinal").collect()
    assert [s.symbol for s in stocks if s.ordinal is not None] == ["A", "B", "C"]


def test_numbers_of_any_size(spark):
    texts = ["1e100", "1e300", "1e300x", "1e400", "9" * 320, "9" * 400, "1" + "0" * 200, "1e-400", "-1e999", "inf", "1e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(parse_strict(F.col("t")), parse_loose(F.col("t")), parse_prefix(F.col("t"))).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == [1e100, 1e300, None, None, None, None, 1e200, 0.0, None, None, None]
    assert [r[2] for r in got] == [1e100, 1e300, 1e300, None, None, None, 1e200, 0.0, None, None, 1.0]


def test_last_row_of_a_day_as_a_whole(spark):
    kind = "symbol string, date string, close double, adj_close double, volume double, ordinal long"
    rows = [("a-b", "2020-01-01", 1.0, None, 5.0, None), ("a-b", "2020-01-01", 2.0, None, 6.0, 1), ("A.B", "2020-01-01", 3.0, 3.5, None, 2), ("a-b", "2020-01-02", 9.0, 9.0, 1.0, None)]
    bars = clean_bars(spark.createDataFrame(rows + [rows[0]] * 30, kind))
    once = {(r.symbol, str(r.date)): tuple(r)[2:] for r in dedupe_bars(bars).collect()}
    assert once == {("a-b", "2020-01-01"): (2.0, None, 6.0), ("A.B", "2020-01-01"): (3.0, 3.5, None), ("a-b", "2020-01-02"): (9.0, 9.0, 1.0)}
    metrics = eod_metrics(bars, "now").collect()
    assert len(metrics) == 1 and metrics[0].symbol == "A.B" and metrics[0].ma20 is None
    assert (metrics[0].close, metrics[0].adjClose, metrics[0].high52, metrics[0].low52) == (9.0, 9.0, 9.0, 3.0)


def test_state_of_the_screen(spark, tmp_path):
    stocks = [{"symbol": "A", "name": "é", "forwardEPS": 1.5, "risk": {"cyc": 4}, "nextEarningsDate": "2024-05-06", "isCustom": True}, {"symbol": "B", "nextEarningsDate": "", "price": 3}]
    settings = {"analysisMode": 3, "defaultDiscount": 12, "bearGrowthShift": -7, "useFmp": True, "weights": {"cyc": 2.0, "odd": 1}, "newThing": 1}
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"selectedSector": "All", "settings": settings, "stocks": stocks}, indent=2, ensure_ascii=False))
    rows, saved = state.read_state(spark, str(path))
    found = {r.symbol: r for r in rows.collect()}
    assert (found["A"].forward_eps, found["A"].risk.cyc, found["A"].is_custom, str(found["A"].next_earnings_date), found["A"].ordinal) == (1.5, 4.0, True, "2024-05-06", 0)
    assert found["B"].next_earnings_date is None and found["B"].price == 3.0
    cfg, unknown = state.settings_of(saved)
    assert (cfg.analysis_mode, cfg.default_discount, cfg.bear_growth_shift, cfg.weights) == (3, 12, -7, RiskWeights(cyc=2.0))
    assert unknown == ["newThing", "weights.odd"]
    # written parts put end to end are one document of the same kind
    state.write_state(rows, cfg, str(tmp_path / "parts"))
    parts = sorted((tmp_path / "parts").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert [s["symbol"] for s in document["stocks"]] == ["A", "B"] and document["settings"]["defaultDiscount"] == 12
    again, saved = state.read_state_parts(spark, str(tmp_path / "parts"))
    assert [r.symbol for r in again.orderBy("ordinal").collect()] == ["A", "B"] and state.settings_of(saved) == (cfg, [])


def test_settings_and_sort_keys():
    assert ScreenConfig(analysis_mode="1y").horizon.years == 1.0
    assert ScreenConfig(analysis_mode="y").horizon.years == 5.0
    assert replace(ScreenConfig(), analysis_mode=None, years=None).horizon.years < 0.8
    names = {"forwardEPS": "forward_eps", "bearFV": "bear_fv", "drawdown52High": "drawdown52_high", "from52Low": "from52_low", "isCustom": "is_custom", "range52": "range_position", "peg": "peg", "return1m": "return1m"}
    assert {k: column_name(k) for k in names} == names

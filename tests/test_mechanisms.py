"""Partitioned feeds, sketches, peer sets, change sets, mixed records, search by trigrams, rejected rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tests.test_plans import no_broadcast, plan  # noqa: F401
from tickersieve.functions.text import matches_search
from tickersieve.operators import changes, mixed, search, sketches
from tickersieve.operators.peers import in_peer_sets, with_peer_stats
from tickersieve.operators.score import score
from tickersieve.plans import bindings as B
from tickersieve.plans import catalog, views
from tickersieve.sources import landing, rejects


def test_only_the_newest_useful_day_is_read(spark, tmp_path):
    path = str(tmp_path / "bulk")
    rows = [("2001-11-02", '[{"symbol":"x","close":1}]'), ("2001-11-01", '{"data":[{"ticker":"a-b","close":"3.5"},{"symbol":"q","price":2}]}'), ("2001-10-31", '[{"symbol":"a.b","close":9}]')]
    landing.land_bulk(spark.createDataFrame(rows, "date string, json string"), path)
    wanted = spark.createDataFrame([("A-B",), ("NONE",)], "symbol string")
    found = landing.bulk_latest_partition(spark, path, wanted, "2001-11-04")
    assert [tuple(r) for r in found.collect()] == [("A.B", 3.5, dt.date(2001, 11, 1))]
    day = landing.bulk_day(spark, path, dt.date(2001, 11, 1))
    assert day.count() == 2 and all("/date=2001-11-01/" in f for f in day.inputFiles())
    assert landing.bulk_day(spark, path, dt.date(2001, 11, 3)).isEmpty()
    assert landing.bulk_latest_partition(spark, path, wanted.limit(0), "2001-11-04").isEmpty()
    assert landing.recent_days("2001-11-04", 9) == [dt.date(2001, 11, d) for d in (2, 1)] + [dt.date(2001, 10, d) for d in (31, 30, 29)]


def test_sketches_merge_and_keep_their_bound(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 10).alias("file"), F.when(F.col("id") % 50 > 0, F.rand(5) * F.rand(6)).alias("v"))
    found = sketches.quantile(sketches.merged_sketches(sketches.value_sketches(rows, "v", "g", "file"), "g"), 0.5)
    for r in found.collect():
        ranked = rows.where((F.col("g") == r.g) & F.col("v").isNotNull())
        assert r.n == ranked.count()
        assert abs(ranked.where(F.col("v") <= r.median).count() / r.n - 0.5) <= sketches.RANK_ERROR
    empty = sketches.approximate_median(rows.where("v is null"), "g", "v")
    assert empty.isEmpty()


def test_five_peer_sets_from_one_ranking(spark, sf_dir, no_broadcast):  # noqa: F811
    stocks = catalog.stocks(spark, sf_dir)
    cfg = catalog._VIEWS
    text = plan(with_peer_stats(in_peer_sets(stocks, views.peer_sets(cfg)), peer_by="peer").select("symbol", "peer_set", "median_pe", "pe_percentile"))
    # values are counted, and so shuffled, once; other readers reuse that exchange
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(peer#\d+, current_pe#\d+", text)) == 0
    assert len(re.findall(r"\+- Exchange hashpartitioning\(_peer#\d+, current_pe#\d+", text)) == 1
    one = score(stocks, cfg, B.AS_OF, peer_by="sector").select("symbol", "status", "short_score")
    many = views.scored_for_views(stocks, cfg, B.AS_OF).where("peer_set = 'own_sector'").select("symbol", "status", "short_score")
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_rescoring_equals_scoring_anew_and_touches_little(spark, sf_dir):
    old = catalog.stocks(spark, sf_dir)
    scores = score(old, B.CONFIG, B.AS_OF, peer_by="sector").select("symbol", "status", "pe_percentile", "short_score")
    new = old.withColumn("price", F.when(F.col("sector") == "Energy", F.col("price") * 2).otherwise(F.col("price")))
    found = changes.rescored(scores, old, new, B.CONFIG, B.AS_OF)
    full = score(new, B.CONFIG, B.AS_OF, peer_by="sector").select("symbol", "status", "pe_percentile", "short_score")
    assert found.exceptAll(full).isEmpty() and full.exceptAll(found).isEmpty()
    moved = changes.moved_groups(old, new, changes.row_changes(old, new))
    assert [r.group for r in moved.collect()] == ["Energy"]
    assert changes.moved_groups(old, old, changes.row_changes(old, old)).isEmpty()
    same = changes.rescored(scores, old, old, B.CONFIG, B.AS_OF)
    assert same.exceptAll(scores).isEmpty() and same.count() == old.count()


def test_a_stock_that_moves_moves_both_sectors(spark):
    schema = "symbol string, sector string, price double, forward_eps double"
    old = spark.createDataFrame([("A", "x", 1.0, 1.0), ("B", "y", 1.0, 1.0), ("C", None, 1.0, 1.0)], schema)
    new = spark.createDataFrame([("A", "y", 1.0, 1.0), ("B", "y", 1.0, 1.0), ("D", None, 1.0, 1.0)], schema)
    change = changes.row_changes(old, new)
    assert {tuple(r) for r in change.collect()} == {("A", "changed"), ("B", "unchanged"), ("C", "deleted"), ("D", "inserted")}
    assert {r.group for r in changes.moved_groups(old, new, change).collect()} == {"x", "y", ""}


def test_records_of_any_shape_are_parsed_once(spark):
    rows = [
        ("a", '{"chart":{"result":[{"timestamp":[86400,172800,259200],"indicators":{"quote":[{"close":[1.5,"2",null]}]}}],"error":null}}'),
        ("b", '{"chart":{"result":[{"indicators":{"quote":[{"close":[3]}]}}]}}'),
        ("-", '{"symbol":"c-d","historical":[{"date":"d1","adjClose":"4 USD"},{"date":"d0","close":9}]}'),
        ("-", '{"historicalStockList":[{"symbol":"e","historical":[{"date":"d2","close":5}]},{"symbol":"","historical":[{"close":1}]}]}'),
        ("f", '{"historical":[{"date":"d3","price":1},{"date":"d4","close":6},{"date":"d4","close":7}]}'),
        ("-", '{"data":[{"ticker":"g","price":7},{"symbol":"h","close":0}]}'),
        ("-", '[{"symbol":"i","date":"d5","close":8},{"symbol":"j","historical":[{"date":"d6","close":9}]}]'),
        ("k", "{not json"), ("l", None), ("m", "3"), ("n", "[]"), ("o", '{"chart":{"error":{"code":"404"}}}'), ("p", '{"other":1}'),
    ]
    df = mixed.mixed_quotes(spark.createDataFrame(rows, "symbol string, json string"))
    found = {tuple(r) for r in df.collect()}
    assert found == {
        ("chart", "A", 2.0, "1970-01-03"), ("chart", "B", 3.0, None), ("history", "C.D", 4.0, "d1"), ("history", "E", 5.0, "d2"),
        ("light", "F", 6.0, "d4"), ("list", "G", 7.0, None), ("list", "I", 8.0, "d5"), ("history", "J", 9.0, "d6"),
    }
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parseJson") + text.count("parse_json") == 1 and "from_json" not in text


@pytest.mark.parametrize("needle", ["7", "e", "in", "ed ", "ring", " RED ", "health care", "zzz", "%", "", "p-1"])
def test_search_finds_what_a_scan_finds(spark, sf_dir, needle):
    stocks = catalog.stocks(spark, sf_dir)
    grams = search.write_postings(stocks)
    found = search.search(stocks, grams, needle).select("symbol")
    scan = stocks.where(matches_search(needle, *[F.col(c) for c in search.COLUMNS])).select("symbol")
    assert found.exceptAll(scan).isEmpty() and scan.exceptAll(found).isEmpty()


def test_search_reads_only_its_grams(spark, sf_dir):
    grams = search.write_postings(catalog.stocks(spark, sf_dir))
    text = plan(search.search(catalog.stocks(spark, sf_dir), grams, "ring"))
    assert re.search(r"PushedFilters: \[In\(gram, \[ing,rin\]\)", text)
    assert "StringStartsWith(gram,e)" in plan(search.search(catalog.stocks(spark, sf_dir), grams, "E"))


def test_rejected_rows_have_a_reason_and_a_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text('symbol,name\nA,"x, y"\nB\n\nC,z,extra\n , \nD,""\n')
    (tmp_path / "b.csv").write_text("symbol,name\nE,e\n")
    good, rejected = rejects.read_csv_checked(spark, str(tmp_path))
    assert [(r.symbol, r.name) for r in good.orderBy("ordinal").collect()] == [("A", "x, y"), ("D", ""), ("E", "e")]
    bad = rejected.orderBy("position").collect()
    assert [(r.reason, r.line) for r in bad] == [("too few cells", "B"), ("too many cells", "C,z,extra"), ("blank", "")]
    assert all(r.file.endswith("a.csv") for r in bad)

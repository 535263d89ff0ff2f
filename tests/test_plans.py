"""What the plans must and must not contain."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tickersieve.operators.bars import bar_metrics, clean_bars, eod_metrics
from tickersieve.operators.score import score
from tickersieve.plans import bindings as B
from tickersieve.plans import catalog, views
from tickersieve.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_metrics_use_one_exchange_and_one_sort(spark, sf_dir, no_broadcast, tmp_path):
    B.bars(spark, sf_dir).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    text = plan(eod_metrics(bars, "now", "2001-11-04", 13))
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", text)) == 1
    assert text.count("Exchange ") == 1
    assert len(re.findall(r"\bSort \[", text)) == 1
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThan(date,2000-10-04)" in pushed and "LessThanOrEqual(date,2001-11-04)" in pushed
    last = plan(bar_metrics(clean_bars(bars)).select("symbol", "close", "date"))
    assert "Window" not in last and last.count("Exchange ") == 1
    assert "ReadSchema: struct<symbol:string,date:date,close:double>" in last


def test_merges_keep_the_partitioning_of_the_universe(spark, sf_dir, no_broadcast):
    text = plan(B.stocks(spark, sf_dir, with_overrides=True))
    # The left side of the merge joins is shuffled once, to choose one row per symbol.
    left = [line for line in text.splitlines() if re.match(r"^[ :]*\+- .*SortMergeJoin \[symbol", line)]
    assert len(left) == 3
    assert "python" not in text.lower()


def test_ranks_use_no_single_task_over_stocks(spark, sf_dir, no_broadcast):
    text = plan(score(catalog.stocks(spark, sf_dir), B.CONFIG, B.AS_OF, peer_by="sector"))
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # Windows over a peer group run over bins, never over stocks or distinct ratios.
    for line in text.splitlines():
        if "Window [" in line and re.search(r"\], \[_peer#\d+\]", line):
            assert "coarse" in line


def test_one_group_of_peers_needs_no_nested_loop(spark, sf_dir, no_broadcast):
    text = plan(score(catalog.stocks(spark, sf_dir), B.CONFIG, B.AS_OF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # What meets in one task are coarse bins and single figures.
    for line in text.splitlines():
        if "Window [" in line and "coarse" not in line:
            assert "fine" in line or "current_pe" in line


def test_filtered_screens_score_once(spark, sf_dir, no_broadcast):
    stocks = catalog.stocks(spark, sf_dir)
    plain = plan(views.screen(stocks, B.CONFIG, B.AS_OF)).count("SortMergeJoin")
    filtered = plan(views.screen(stocks, replace(B.CONFIG, status_filter="Okay"), B.AS_OF)).count("SortMergeJoin")
    assert filtered == plain
    sector = replace(B.CONFIG, selected_sector="Energy", search="r")
    judged = replace(sector, status_filter="Okay")
    assert plan(views.screen(stocks, judged, B.AS_OF)).count("SortMergeJoin") == plan(views.screen(stocks, sector, B.AS_OF)).count("SortMergeJoin")
    found = replace(B.CONFIG, search="r", status_filter="Okay")
    both = replace(found, status_filter="All")
    assert plan(views.screen(stocks, found, B.AS_OF)).count("SortMergeJoin") <= plan(views.screen(stocks, both, B.AS_OF)).count("SortMergeJoin") + 2  # the semi join, under both readers of the rows


def test_the_price_job_shuffles_bars_once(spark, sf_dir, no_broadcast):
    text = plan(eod_metrics(B.bars_short(spark, sf_dir).withColumn("ordinal", F.lit(1)).repartition(3), "now"))
    after = text[: text.index("RoundRobin")] if "RoundRobin" in text else text
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", after)) == 1


def test_top_lists_do_not_sort_everything(spark, sf_dir):
    text = plan(views.extremes_top(catalog.stocks(spark, sf_dir), B.CONFIG, B.AS_OF))
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["eod_metrics", "fund_from_json", "scored_own_sector", "summary_cards", "chart_last_close"])
def test_no_python_in_plans(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search(r"EvalPython|MapInPandas|FlatMapGroups|ArrowEval", text)

"""Named queries over the test tables, one or more per operator.

Numbers are rounded to 6 decimals and structs flattened, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickersieve.config import ScreenConfig
from tickersieve.functions import dates as D
from tickersieve.functions import numbers as N
from tickersieve.functions import scoring as S
from tickersieve.functions import text as X
from tickersieve.functions import valuation as V
from tickersieve.functions.symbols import normalize_symbol, to_api_symbol
from tickersieve.operators import bars as bar_ops
from tickersieve.operators import bar_state, changes, feeds, mixed, search, sketches, snapshots, universe
from tickersieve.operators.score import score, with_scores, with_valuation
from tickersieve.operators.peers import in_peer_sets, with_peer_stats
from tickersieve.operators.rows import last_per_key
from tickersieve.plans import bindings as B
from tickersieve.plans import jobs, views
from tickersieve.session import apply_settings
from tickersieve.sources import bars_store, files, landing, rejects, state
from tickersieve.sources.store import new_path, store

Query = Callable[[SparkSession, str], DataFrame]
CFG, AS_OF, AT = B.CONFIG, B.AS_OF, B.UPDATED_AT
QUERIES: dict[str, Query] = {}

# The stored stock table per session and state of the input files, as the screen keeps it between views.
_stored: dict[tuple, DataFrame] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = lambda spark, sf_dir: tidy(function(apply_settings(spark), sf_dir))
    return function


def tidy(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType):
            columns += [
                F.round(column[inner], 6).alias(f"{field.name}_{inner}")
                for inner in field.dataType.fieldNames()
            ]
        elif isinstance(field.dataType, T.ArrayType):
            columns.append(F.concat_ws("|", column).alias(field.name))
        elif isinstance(field.dataType, T.DoubleType):
            columns.append(F.round(column, 6).alias(field.name))
        elif isinstance(field.dataType, T.DateType):
            columns.append(column.cast("string").alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            # A collated column compares as plain text again.
            columns.append(column.cast("string").alias(field.name))
        else:
            columns.append(column)
    return df.select(*columns)


def _file_state(spark: SparkSession, sf_dir: str) -> tuple[tuple[str, int, int], ...]:
    """Name, time and size of what the folder's stock tables are made of."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f for f in system.listStatus(folder) if f.getPath().getName() in ("part.parquet", "lineitem.parquet")]
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in found))


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, _file_state(spark, sf_dir))
    if key not in _stored:
        _stored[key] = store(B.stocks(spark, sf_dir), "stocks")
    return _stored[key]


def scored(spark: SparkSession, sf_dir: str, cfg: ScreenConfig = CFG) -> DataFrame:
    return score(stocks(spark, sf_dir), cfg, AS_OF)


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_valuation(stocks(spark, sf_dir), CFG, AS_OF)


# Bars ---------------------------------------------------------------------------------------


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.bar_metrics(bar_ops.clean_bars(B.bars(spark, sf_dir)))


@query
def eod_last(spark, sf_dir):
    return metrics(spark, sf_dir).select("symbol", "date", "close", "adj_close", "volume")


@query
def range52(spark, sf_dir):
    return metrics(spark, sf_dir).select(
        "symbol", "high52", "low52", "range52", "distance52_high", "distance52_low"
    )


@query
def avg_volume(spark, sf_dir):
    return metrics(spark, sf_dir).select("symbol", "avg_volume3m")


@query
def trailing_returns(spark, sf_dir):
    return metrics(spark, sf_dir).select("symbol", *bar_ops.RETURN_LOOKBACKS)


@query
def moving_avg(spark, sf_dir):
    return metrics(spark, sf_dir).select("symbol", *bar_ops.MOVING_AVERAGES)


@query
def volatility(spark, sf_dir):
    return metrics(spark, sf_dir).select("symbol", "volatility4m")


@query
def max_drawdown(spark, sf_dir):
    return metrics(spark, sf_dir).select("symbol", "max_drawdown4m")


@query
def eod_metrics(spark, sf_dir):
    return bar_ops.eod_metrics(B.bars(spark, sf_dir), AT, one_a_day=True)


@query
def eod_metrics_short(spark, sf_dir):
    return bar_ops.eod_metrics(B.bars_short(spark, sf_dir), AT, one_a_day=True)


@query
def eod_metrics_13mo(spark, sf_dir):
    return bar_ops.eod_metrics(B.bars(spark, sf_dir), AT, AS_OF, 13, one_a_day=True)


@query
def eod_metrics_long_history(spark, sf_dir):
    """From a table of bars, with the newest values of each symbol chosen before the exchange."""
    return bar_ops.eod_metrics_long_history(store(B.bars(spark, sf_dir), "bars"), AT)


@query
def eod_metrics_bucketed(spark, sf_dir):
    """From a table of bars in buckets of symbols: no exchange at all."""
    bars = bars_store.write_bars(B.bars(spark, sf_dir), "bars", 8)
    return bar_ops.price_rows(bar_ops.bar_metrics(bars), AT)


@query
def eod_metrics_incremental(spark, sf_dir):
    """Most of the history at first, then new days in three deliveries, and at last late and corrected bars.

    At first some days are left out, some have another close, and some a close that is taken back later."""
    bars = store(B.bars(spark, sf_dir), "bars")
    day, key = F.dayofmonth("date"), F.crc32("symbol")
    late, wrong, void = day == 1 + key % 7, day == 20 + key % 5, day == 26 + key % 2
    edges = ["2001-06-30", "2001-08-31", "2001-09-30"]
    delivered = bars.where(~late).withColumn("close", F.when(wrong | (void & F.col("close").isNull()), F.dayofyear("date") * 1.0).otherwise(F.col("close")))
    kept = lambda df: bars_store.write_by_symbol(df, "bar_state", 8)
    state_rows = kept(bar_state.initial_state(delivered.where(F.col("date") <= edges[0])))
    for since, until in zip(edges, [*edges[1:], "9999-12-31"]):
        state_rows = kept(bar_state.merge_state(state_rows, delivered.where((F.col("date") > since) & (F.col("date") <= until))))
    state_rows = kept(bar_state.merge_state(state_rows, bars.where(late | wrong | void)))
    return bar_ops.price_rows(bar_state.state_metrics(bar_state.rebuilt(state_rows, bars)), AT)


@query
def dedupe_bars(spark, sf_dir):
    """Line items as repeated bars: the last order of a supplier's day wins."""
    lines = B.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s-"), F.col("l_suppkey")).alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("close"),
        (F.col("l_extendedprice") * 0.97).alias("adj_close"),
        F.col("l_quantity").alias("volume"),
        _line_order().alias("ordinal"),
    )
    return bar_ops.dedupe_bars(lines)


def _line_order():
    """Orders line items; any orderable value can be an ordinal of bars."""
    return F.struct("l_orderkey", "l_linenumber", "l_partkey")


@query
def price_job_repeated(spark, sf_dir):
    """The price job on line items as repeated bars under two spellings of each symbol, half of
    them without an ordinal."""
    spelling = F.when(F.col("l_linenumber") % 2 == 0, F.lit("s-")).otherwise(F.lit(" S."))
    lines = B.table(spark, sf_dir, "lineitem").select(
        F.concat(spelling, F.col("l_suppkey")).alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("close"),
        (F.col("l_extendedprice") * 0.97).alias("adj_close"),
        F.col("l_quantity").alias("volume"),
        F.when(F.col("l_partkey") % 2 == 0, _line_order()).alias("ordinal"),
    )
    universe_rows = B.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S-"), "s_suppkey").alias("symbol"))
    path = new_path(spark, "prices")
    jobs.price_job(lines, universe_rows, path, AT, AS_OF)
    return snapshots.resolve_price_snapshot(files.read_csv(spark, path)).drop("ordinal")


@query
def panel_to_long(spark, sf_dir):
    """The panel has one group of columns per nation, so its width is fixed."""
    lines = B.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    suppliers = B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    daily = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("nation"), F.to_date("l_shipdate").alias("date"))
        .agg(F.max("l_extendedprice").alias("top"), F.sum("l_quantity").alias("quantity"))
    )
    nations = [f"N{i}" for i in range(25)]
    open_day = F.dayofmonth("date") != F.col("nation") + 1
    panel = (
        daily.select(
            "date",
            F.concat(F.lit("N"), F.col("nation")).alias("ticker"),
            F.when(open_day, F.col("top")).alias("close"),
            F.when(open_day & (F.col("nation") % 2 == 0), F.col("quantity")).alias("volume"),
        )
        .groupBy("date")
        .pivot("ticker", nations)
        .agg(F.max("close").alias("Close"), F.max("volume").alias("Volume"))
    )
    wide = panel.select(
        "date",
        *[F.col(f"{n}_{f}").alias(f"{n}|{f}") for n in nations for f in ("Close", "Volume")],
        *[(F.col(f"{n}_Close") * 0.5).alias(f"{n}|Adj Close") for n in nations[:10]],
    )
    return bar_ops.panel_to_long(wide, [*nations, "NONE"])


# Feeds --------------------------------------------------------------------------------------


def _histories(spark, sf_dir) -> DataFrame:
    """Bars per supplier as one array, oldest day first; its length is the number of days."""
    return (
        B.bars(spark, sf_dir)
        .groupBy("symbol")
        .agg(F.sort_array(F.collect_list(F.struct("date", "close", "adj_close"))).alias("h"))
        .withColumn("key", F.substring("symbol", 3, 20).cast("long"))
    )


@query
def chart_last_close(spark, sf_dir):
    h = F.col("h")
    key = F.col("key")
    epoch = lambda d: F.unix_date(d).cast("long") * 86400
    times = F.transform(h, lambda x: epoch(x["date"]))
    # Some charts have fewer timestamps than closes, some an error, some no result.
    times = F.when(key % 7 == 3, F.slice(times, 1, 5)).otherwise(times)
    quote = F.struct(F.transform(h, lambda x: x["close"]).alias("close"))
    result = F.struct(
        times.alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators")
    )
    failure = F.when(
        key % 11 == 5, F.struct(F.lit("404").alias("code"), F.lit("no data").alias("description"))
    )
    chart = F.struct(
        F.when(key % 13 == 6, F.array().cast(T.ArrayType(T.StringType())))
        .otherwise(F.array(F.to_json(result)))
        .alias("texts"),
        failure.alias("error"),
    )
    # Nested JSON is put together as text, as a vendor would send it.
    text = F.concat(
        F.lit('{"chart":{"result":['),
        F.array_join(chart["texts"], ","),
        F.lit('],"error":'),
        F.coalesce(F.to_json(chart["error"]), F.lit("null")),
        F.lit("}}"),
    )
    return feeds.chart_last_close(_histories(spark, sf_dir).select("symbol", text.alias("json")))


@query
def hist_json_latest(spark, sf_dir):
    """Responses of three suppliers each, in the three shapes by turns."""
    newest = F.reverse(
        F.transform(
            "h",
            lambda x: F.struct(
                x["date"].cast("string").alias("date"),
                x["close"].alias("close"),
                x["adj_close"].alias("adjClose"),
                F.lit(7.5).alias("price"),
            ),
        )
    )
    batch = F.floor(F.col("key") / 3)
    one = F.to_json(F.struct("symbol", newest.alias("historical")))
    flat = F.to_json(
        F.struct(
            F.lit("").alias("symbol"),
            F.col("symbol").alias("ticker"),
            F.element_at("h", -1)["date"].cast("string").alias("date"),
            F.element_at("h", -1)["adj_close"].alias("adjClose"),
            F.lit(7.5).alias("price"),
        )
    )
    items = _histories(spark, sf_dir).select(
        batch.alias("batch"), F.when(batch % 3 == 2, flat).otherwise(one).alias("item"), "key"
    )
    grouped = items.withColumn(
        "part", F.when(F.col("batch") % 3 == 1, F.col("key")).otherwise(F.lit(-1))
    )
    responses = grouped.groupBy("batch", "part").agg(
        F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")
    )
    json = (
        F.when(F.col("batch") % 3 == 0, F.concat(F.lit('{"historicalStockList":['), "items", F.lit("]}")))
        .when(F.col("batch") % 3 == 1, F.col("items"))
        .otherwise(F.concat(F.lit(" ["), "items", F.lit("]")))
    )
    return feeds.price_api_latest(responses.select(json.alias("json")))


@query
def chart_text_numbers(spark, sf_dir):
    """Closes as bare and as quoted numbers, with words in between: no cell costs a record."""
    cell = lambda x: (
        F.when(x["close"].isNull(), "null")
        .when(F.dayofmonth(x["date"]) % 5 == 1, '"n/a"')
        .when(F.dayofmonth(x["date"]) % 2 == 0, F.concat(F.lit('" '), x["close"].cast("string"), F.lit('"')))
        .otherwise(x["close"].cast("string"))
    )
    time = lambda x: (F.unix_date(x["date"]).cast("long") * 86400).cast("string")
    text = F.concat(
        F.lit('{"chart":{"result":[{"timestamp":['),
        F.array_join(F.transform("h", time), ","),
        F.lit(']  ,"indicators":{"quote":[{"close":['),
        F.array_join(F.transform("h", cell), ","),
        F.lit("]}]}}],\"error\":null}}"),
    )
    return feeds.chart_last_close(_histories(spark, sf_dir).select("symbol", text.alias("json")))


@query
def hist_text_numbers(spark, sf_dir):
    last = F.element_at("h", -1)
    quoted = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))
    close = (
        F.when(F.dayofmonth(last["date"]) % 3 == 0, '"7.25 USD"')
        .when(last["close"].isNull(), F.lit("null"))
        .otherwise(quoted(last["close"]))
    )
    text = F.concat(
        F.lit('{"symbol":"'), "symbol", F.lit('","historical":[{"date":"'), last["date"].cast("string"),
        F.lit('","close":'), close,
        F.lit(',"adjClose":'), F.coalesce(quoted(last["adj_close"]), F.lit("null")),
        F.lit(',"price":"7.25"}]}'),
    )
    return feeds.price_api_latest(_histories(spark, sf_dir).select(text.alias("json")))


def _rows_json(wrap, rows):
    """A list of rows bare or under one of the two names, by a number."""
    text = F.to_json(rows)
    return (
        F.when(wrap % 3 == 0, text)
        .when(wrap % 3 == 1, F.concat(F.lit('{"historical":'), text, F.lit("}")))
        .otherwise(F.concat(F.lit('{"data":'), text, F.lit("}")))
    )


@query
def light_json(spark, sf_dir):
    """One response per symbol in the three wrappings; every other price is quoted."""
    row = lambda x: F.struct(
        x["date"].cast("string").alias("date"),
        x["close"].alias("close"),
        x["adj_close"].cast("string").alias("adjClose"),
        F.when(F.dayofmonth(x["date"]) % 2 == 0, x["close"].cast("string")).alias("price"),
    )
    responses = _histories(spark, sf_dir).select("symbol", _rows_json(F.col("key"), F.transform("h", row)).alias("json"))
    return feeds.light_latest(feeds.light_rows(responses))


@query
def bulk_json(spark, sf_dir):
    """One response per day and 16 suppliers, in the three wrappings, under either symbol name."""
    key = F.substring("symbol", 3, 20).cast("long")
    row = F.struct(
        F.when(key % 2 == 0, F.col("symbol")).alias("symbol"),
        F.col("symbol").alias("ticker"),
        F.col("close").cast("string").alias("close"),
        F.col("adj_close").alias("adjClose"),
    )
    days = B.bars(spark, sf_dir).groupBy("date", F.floor(key / 16).alias("part")).agg(F.collect_list(row).alias("rows"))
    responses = days.select("date", _rows_json(F.dayofmonth("date"), F.col("rows")).alias("json"))
    rich = B.table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    wanted = rich.select(F.concat(F.lit("S."), F.col("s_suppkey")).alias("symbol"))
    return feeds.bulk_latest_date(feeds.bulk_rows(responses), wanted, AS_OF)


def _quotes(spark, sf_dir, bars=B.bars) -> DataFrame:
    return bars(spark, sf_dir).select(
        "symbol",
        "date",
        F.when(F.dayofmonth("date") % 2 == 0, F.col("close")).alias("price"),
        "close",
        "adj_close",
    )


@query
def light_latest(spark, sf_dir):
    return feeds.light_latest(_quotes(spark, sf_dir))


@query
def bulk_latest_date(spark, sf_dir):
    rich = B.table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    wanted = rich.select(F.concat(F.lit("S."), F.col("s_suppkey")).alias("symbol"))
    return feeds.bulk_latest_date(_quotes(spark, sf_dir), wanted, AS_OF)


@query
def bulk_partitioned(spark, sf_dir):
    """The bulk feed landed in one partition per day; the newest useful day alone is read."""
    key = F.substring("symbol", 3, 20).cast("long")
    row = F.struct("symbol", F.col("close").cast("string").alias("close"), F.col("adj_close").alias("adjClose"))
    days = B.bars(spark, sf_dir).groupBy("date", F.floor(key / 16).alias("part")).agg(F.collect_list(row).alias("rows"))
    path = new_path(spark, "bulk")
    landing.land_bulk(days.select("date", _rows_json(F.dayofmonth("date"), F.col("rows")).alias("json")), path)
    rich = B.table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    wanted = rich.select(F.concat(F.lit("S."), F.col("s_suppkey")).alias("symbol"))
    return landing.bulk_latest_partition(spark, path, wanted, AS_OF)


@query
def mixed_folder(spark, sf_dir):
    """Records of all shapes in one folder, by turns of the supplier, and some that are no JSON."""
    h, turn = F.col("h"), F.col("key") % 6
    quote = lambda x: F.struct(x["date"].cast("string").alias("date"), x["close"].alias("close"), x["adj_close"].alias("adjClose"))
    newest, oldest = F.reverse(F.transform(h, quote)), F.transform(h, quote)
    epochs = F.transform(h, lambda x: F.unix_date(x["date"]).cast("long") * 86400)
    result = F.struct(epochs.alias("timestamp"), F.struct(F.array(F.struct(F.transform(h, lambda x: x["close"]).alias("close"))).alias("quote")).alias("indicators"))
    chart = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    one = F.struct("symbol", newest.alias("historical"))
    last = F.element_at(h, -1)
    row = F.struct(F.col("symbol").alias("ticker"), last["date"].cast("string").alias("date"), F.concat(last["adj_close"].cast("string"), F.lit(" USD")).alias("adjClose"))
    text = (
        F.when(turn == 0, F.to_json(chart))
        .when(turn == 1, F.to_json(one))
        .when(turn == 2, F.to_json(F.struct(F.array(one).alias("historicalStockList"))))
        .when(turn == 3, F.to_json(F.struct(oldest.alias("historical"))))
        .when(turn == 4, F.to_json(F.struct(F.array(row).alias("data"))))
        .otherwise(F.when(F.col("key") % 4 == 1, "{not json").otherwise(F.to_json(F.array(row))))
    )
    path = new_path(spark, "mixed")
    _histories(spark, sf_dir).select("symbol", text.alias("json")).write.parquet(path)
    return mixed.mixed_quotes(spark.read.parquet(path))


@query
def fund_from_json(spark, sf_dir):
    f = B.fund(spark, sf_dir)
    key = F.col("ordinal")
    number = lambda c: c.try_cast("double")
    record = F.struct(
        F.when(key % 4 == 0, "").otherwise(F.col("name")).alias("shortName"),
        F.concat(F.lit("Long "), F.col("name")).alias("longName"),
        "sector",
        F.col("sub_industry").alias("industry"),
        number(F.col("forward_eps")).alias("forwardEps"),
        number(F.col("trailing_eps")).alias("trailingEps"),
        number(F.col("forward_pe")).alias("forwardPE"),
        F.when(key % 6 == 0, "NaN").when(key % 6 == 1, "Infinity").otherwise("1.25").alias("pegRatio"),
        number(F.col("gross_margins")).alias("grossMargins"),
        number(F.col("beta")).alias("beta"),
        (key * 1000000007).alias("marketCap"),
        F.when(key % 3 == 0, F.lit(1004832000) + key % 40 * 86400).alias("earningsTimestamp"),
        F.when(key % 3 == 1, F.lit(0) - key % 2).alias("earningsTimestampStart"),
        (F.lit(1004918400) + key % 3 * 3600).alias("earningsTimestampEnd"),
    )
    failed = F.when(key % 29 == 4, F.repeat(F.lit("timeout while fetching "), 12))
    records = f.select("symbol", F.to_json(record).alias("json"), failed.alias("error"))
    return feeds.info_to_fundamentals(records, AT)


@query
def price_waterfall(spark, sf_dir):
    """The first feed prices no wanted stock, so the second one is used alone."""
    wanted = B.fund(spark, sf_dir)
    foreign = feeds.light_latest(_quotes(spark, sf_dir))
    own = feeds.light_latest(_quotes(spark, sf_dir, B.bars_short))
    listed = wanted.select("symbol", "price", F.lit(AS_OF).cast("date").alias("date"))
    return feeds.price_waterfall(wanted, foreign, own, listed)


@query
def price_candidates(spark, sf_dir):
    last = metrics(spark, sf_dir)
    key = F.substring("symbol", 3, 20).cast("long")
    first = last.select(
        "symbol",
        F.lit(0).alias("rank"),
        F.when(key % 5 != 1, F.col("close")).alias("price"),
        "date",
        F.when(key % 5 == 2, "HTTP 402").otherwise("").alias("error"),
    )
    second = last.select(
        "symbol", F.lit(1).alias("rank"), F.col("adj_close").alias("price"), "date", F.lit(None).cast("string").alias("error")
    )
    return feeds.price_candidates(second.unionByName(first))


# Scalars ------------------------------------------------------------------------------------


@query
def symbol_norm(spark, sf_dir):
    raw = F.concat(F.lit("  brk-"), F.col("p_partkey"), F.lit(".b "))
    return B.table(spark, sf_dir, "part").select(
        "p_partkey", normalize_symbol(raw).alias("symbol"), to_api_symbol(raw).alias("api_symbol")
    )


@query
def num_parse(spark, sf_dir):
    # Edge texts, one per remainder.
    texts = ["", " 3 ", "12%", "$3,000", "1.5", "1.6", "-0.05", "NaN", "1d", "12abc", ".5", "2e3", "-", "+7.", "1e5x"]
    texts += ["1e100", "1e300", "1e300x", "1e400", "-1e400x", "9" * 320, "1" + "0" * 200, "1e-320x", "2E+03"]
    text = F.element_at(
        F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts)).cast("int") + 1
    )
    return B.table(spark, sf_dir, "part").select(
        "p_partkey",
        N.parse_loose(text).alias("loose"),
        N.parse_loose(text, "zero").alias("loose_zero"),
        N.parse_prefix(text).alias("prefix"),
        N.percent_from_text(text).alias("percent"),
    )


@query
def earnings_days(spark, sf_dir):
    day = D.text_to_date(F.col("next_earnings_date"))
    epoch = (F.col("ordinal") % 5 - 1) * 250000000 + F.col("ordinal") * 3600
    return B.fund(spark, sf_dir).select(
        "symbol",
        D.days_until(day, AS_OF).alias("days"),
        D.epoch_to_date(epoch).alias("epoch_day"),
        S.earnings_label(D.days_until(day, AS_OF)).alias("label"),
    )


@query
def fmt_numbers(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select(
        "p_partkey",
        X.percent_text(F.col("p_size") / 32.0).alias("pct1"),
        X.percent_text(F.lit(0) - F.col("p_size") / 64.0, 0).alias("pct0"),
        X.number_text(F.col("p_retailprice") * 1000.0 + F.col("p_size") / 4.0, 1).alias("fmt1"),
        X.number_text(F.when(F.col("p_size") > 3, F.col("p_size") / 7.0), 2).alias("fmt2"),
        X.money_text(F.col("p_retailprice") * 12.5).alias("money"),
    )


@query
def labels(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "symbol",
        X.sector_label(F.col("sector")).alias("sector_label"),
        X.sector_label(F.col("notes")).alias("empty_label"),
        X.status_label(F.col("status")).alias("status_label"),
        X.status_label(F.col("sub_industry")).alias("unknown_label"),
        S.status_class(F.col("status")).alias("status_class"),
    )


@query
def recent_weekdays(spark, sf_dir):
    days = B.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("as_of")).distinct()
    return days.select("as_of", F.explode(D.recent_weekdays(F.col("as_of"), 9)).alias("day"))


# Universe -----------------------------------------------------------------------------------


def _three_files(spark, tables: list[DataFrame]) -> str:
    """Folders of files of very different sizes; the last one in order is the smallest."""
    path = new_path(spark, "files")
    for number, table in enumerate(tables):
        table.write.csv(f"{path}/part={number}", header=True)
    return f"{path}/*"


@query
def snapshot_many_files(spark, sf_dir):
    """Last wins over files without an ordinal column, whatever their sizes."""
    f = B.fund(spark, sf_dir).where("price > 0")
    tables = [
        rows.select("symbol", (F.col("price") * 100 + w).alias("close"))
        for w, rows in enumerate([f, f.where("size > 45"), f.where("size <= 4")])
    ]
    raw = files.read_csv(spark, _three_files(spark, tables))
    latest = last_per_key(snapshots.resolve_price_snapshot(raw), "symbol")
    return latest.select("symbol", "price")


@query
def universe_many_files(spark, sf_dir):
    """Keep-first over files without an ordinal column, whatever their sizes."""
    f = B.fund(spark, sf_dir)
    tables = [
        rows.select(F.col("symbol").alias("Symbol"), F.lit(w).alias("Security"), F.col("sector").alias("GICS Sector"), F.col("sub_industry").alias("GICS Sub-Industry"))
        for w, rows in zip("abc", [f.where("size > 45"), f.where("size <= 4"), f])
    ]
    rows = files.read_constituents(spark, _three_files(spark, tables))
    return universe.union_keep_first(rows).select("symbol", "name")


@query
def universe_symbols(spark, sf_dir):
    return universe.union_keep_first(
        B.constituents(spark, sf_dir), B.local_list(spark, sf_dir), B.shared_list(spark, sf_dir)
    )


@query
def sector_defaults(spark, sf_dir):
    rows = B.fund(spark, sf_dir).withColumn(
        "sector", F.when(F.col("sector") == "Unmapped", F.col("name")).otherwise(F.col("sector"))
    )
    blank = F.when(F.col("size") == 7, "").when(F.col("size") == 8, "Watchlist").otherwise(F.col("sector"))
    return universe.with_sector_defaults(rows.withColumn("sector", blank)).select(
        "symbol",
        "name",
        "sector",
        "eps_growth",
        "rev_growth",
        "gross_margin",
        "op_margin",
        "exit_pe",
        "discount_rate",
        "risk",
    )


_CARRIED = (
    "symbol",
    "name",
    "sector",
    "price",
    "price_source",
    "forward_eps",
    "eps_growth",
    "exit_pe",
    "discount_rate",
    "risk",
    "fundamental_source",
    "fundamental_auto",
    "fundamental_manual",
    "return1m",
    "high52",
    "next_earnings_date",
    "is_custom",
)


@query
def carry_forward(spark, sf_dir):
    new = universe.with_sector_defaults(
        B.fund(spark, sf_dir).withColumn("sector", F.lit("Utilities"))
    )
    old = stocks(spark, sf_dir).where("sector <> 'Energy'")
    return universe.carry_forward(new, old).select(*_CARRIED)


@query
def universe_refresh(spark, sf_dir):
    listed, lists = B.universe_lists(spark, sf_dir)
    old = stocks(spark, sf_dir).where("sector <> 'Energy'")
    return universe.refresh_universe(
        listed.where("sector <> 'Utilities'"), lists, old
    ).select(*_CARRIED)


@query
def watchlist_sync(spark, sf_dir):
    existing = stocks(spark, sf_dir).where("sub_industry <> 'Brand#19'")
    return universe.sync_watchlist(existing, B.shared_list(spark, sf_dir)).select(*_CARRIED, "ordinal")


@query
def watchlist_append(spark, sf_dir):
    return universe.watchlist_additions(
        B.shared_list(spark, sf_dir), B.local_list(spark, sf_dir), AT, "dashboard"
    )


@query
def wanted_semi(spark, sf_dir):
    snapshot = snapshots.resolve_price_snapshot(B.price_text(spark, sf_dir))
    return universe.only_wanted(snapshot, B.shared_list(spark, sf_dir)).select("symbol", "price", "ordinal")


@query
def coverage_gaps(spark, sf_dir):
    """Customers have no bars, suppliers of some nations no closes."""
    suppliers = B.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s-"), F.col("s_suppkey")).alias("symbol"), "s_nationkey"
    )
    customers = B.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c-"), F.col("c_custkey")).alias("symbol")
    )
    closed = B.bars(spark, sf_dir).join(suppliers, "symbol").withColumn(
        "close", F.when(F.col("s_nationkey") > 4, F.col("close"))
    )
    return universe.coverage_gaps(suppliers.select("symbol").unionByName(customers), closed)


# Snapshots ----------------------------------------------------------------------------------


@query
def price_snapshot(spark, sf_dir):
    return snapshots.resolve_price_snapshot(B.price_text(spark, sf_dir))


def universe_rows(spark, sf_dir) -> DataFrame:
    return universe.refresh_universe(*B.universe_lists(spark, sf_dir))


@query
def merge_prices(spark, sf_dir):
    snapshot = snapshots.resolve_price_snapshot(B.price_text(spark, sf_dir))
    merged = snapshots.merge_prices(universe_rows(spark, sf_dir), snapshot)
    return merged.select("symbol", "price", "price_source", *snapshots.PRICE_EXTRAS)


_FUNDED = (
    "symbol",
    "forward_eps",
    "rev_growth",
    "eps_growth",
    "gross_margin",
    "op_margin",
    "exit_pe",
    "next_earnings_date",
    "fundamental_auto",
    "fundamental_manual",
    "fundamental_source",
)


def _funded(spark, sf_dir, cfg: ScreenConfig, overwrite: bool = True) -> DataFrame:
    snapshot = snapshots.resolve_fund_snapshot(B.fund_text(spark, sf_dir))
    return snapshots.fundamental_updates(universe_rows(spark, sf_dir), snapshot, cfg, overwrite)


@query
def merge_fundamentals(spark, sf_dir):
    return _funded(spark, sf_dir, CFG).select(*_FUNDED, "risk")


@query
def merge_fundamentals_zero(spark, sf_dir):
    return _funded(spark, sf_dir, replace(CFG, blank_numeric="zero")).select(*_FUNDED, "risk")


@query
def merge_fundamentals_fill(spark, sf_dir):
    """Without overwriting, only fields that are still missing are set."""
    return _funded(spark, sf_dir, CFG, overwrite=False).select(*_FUNDED, "risk")


@query
def merge_counts(spark, sf_dir):
    return snapshots.merge_counts(_funded(spark, sf_dir, CFG))


@query
def risk_inputs(spark, sf_dir):
    f = B.fund(spark, sf_dir)
    return f.select(
        "symbol",
        V.balance_risk(N.parse_loose(F.col("debt_to_equity"))).alias("balance"),
        V.crowding_risk(N.parse_loose(F.col("forward_pe"))).alias("crowding"),
        V.cyclical_risk(N.parse_loose(F.col("beta"))).alias("cyc"),
        V.margin_risk(N.percent_from_text(F.col("operating_margins"))).alias("margin"),
    )


@query
def overrides(spark, sf_dir):
    edited = snapshots.apply_overrides(stocks(spark, sf_dir), B.overrides(spark, sf_dir))
    return edited.select(
        "symbol",
        "price",
        "price_source",
        "forward_eps",
        "eps_growth",
        "discount_rate",
        "fundamental_auto",
        "fundamental_manual",
        "fundamental_source",
        "risk",
    )


@query
def build_stocks(spark, sf_dir):
    """The whole merge chain in one plan, with edits."""
    return B.stocks(spark, sf_dir, with_overrides=True).select(
        *_FUNDED, "price", "range52", "is_custom", "risk"
    )


# Valuation ----------------------------------------------------------------------------------


@query
def valuation(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol", "current_pe", "required_growth", "peg", "growth_gap")


@query
def fair_value(spark, sf_dir):
    return valued(spark, sf_dir).select(
        "symbol", "bear_fv", "base_fv", "bull_fv", "upside", "sensitivity"
    )


@query
def sector_premium(spark, sf_dir):
    return score(stocks(spark, sf_dir), CFG, AS_OF, peer_by="sector").select(
        "symbol", "current_pe", "median_pe", "sector_premium"
    )


@query
def pe_percentile(spark, sf_dir):
    return with_peer_stats(stocks(spark, sf_dir), peer_by="sector").select(
        "symbol", "sector", "current_pe", "pe_percentile"
    )


@query
def pe_percentile_all(spark, sf_dir):
    return with_peer_stats(stocks(spark, sf_dir)).select("symbol", "pe_percentile", "median_pe")


@query
def position52(spark, sf_dir):
    """Every other stored position is cleared, so that it is derived from the range."""
    cleared = stocks(spark, sf_dir).withColumn(
        "range52", F.when(F.col("ordinal") % 2 == 0, F.col("range52"))
    )
    return with_valuation(cleared, CFG, AS_OF).select(
        "symbol", "range_position", "drawdown52_high", "from52_low"
    )


@query
def momentum(spark, sf_dir):
    """Per supplier, from bars with full histories, under the short and a long horizon."""
    rows = metrics(spark, sf_dir)
    columns = [F.col(c) for c in ("return1m", "return3m", "return4m", "return6m")]
    gap = F.when(F.length("symbol") % 2 == 0, F.lit(None)).otherwise(F.col("return6m"))
    return rows.select(
        "symbol",
        V.momentum(*columns, CFG.horizon).alias("swing"),
        V.momentum(*columns[:3], gap, replace(CFG, analysis_mode=3).horizon).alias("years3"),
    )


@query
def risk_score(spark, sf_dir):
    return valued(spark, sf_dir).select("symbol", "risk_score")


@query
def status(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol", "status")


@query
def confidence(spark, sf_dir):
    return valued(spark, sf_dir).select("symbol", "confidence")


@query
def component_scores(spark, sf_dir):
    parts = ("upside", "percentile", "peg", "gap", "risk", "momentum")
    return scored(spark, sf_dir).select("symbol", *[f"score_{p}" for p in parts])


@query
def short_score(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol", "short_score")


@query
def horizon_scores(spark, sf_dir):
    """The score under every horizon; the peer statistics are shared."""
    ranked = with_peer_stats(stocks(spark, sf_dir))
    base = ranked.columns
    for name, setting in (("swing", 0.33), ("year1", "1"), ("years3", 3), ("years5", "x")):
        cfg = replace(CFG, analysis_mode=setting)
        step = with_scores(with_valuation(ranked, cfg, AS_OF), cfg)
        ranked = step.select(*base, F.col("short_score").alias(name))
        base = ranked.columns
    return ranked.select("symbol", "swing", "year1", "years3", "years5")


@query
def value_trap(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol", "value_trap")


@query
def factor_scores(spark, sf_dir):
    df = scored(spark, sf_dir)
    factors = ("value", "growth", "momentum", "quality", "risk")
    return df.select("symbol", *[f"factor_{f}" for f in factors], *views.graded(df))


@query
def reasons(spark, sf_dir):
    return scored(spark, sf_dir).select("symbol", "reasons")


@query
def buckets(spark, sf_dir):
    c = F.col
    return scored(spark, sf_dir).select(
        "symbol",
        S.score_class(c("short_score")).alias("score_class"),
        S.risk_class(c("risk_score")).alias("risk_class"),
        S.risk_label(c("risk_score")).alias("risk_label"),
        S.range_label(c("range_position")).alias("range_label"),
        S.earnings_label(c("earnings_days")).alias("earnings_label"),
        S.earnings_class(c("earnings_days")).alias("earnings_class"),
        S.origin_tag(c("fundamental_manual"), c("fundamental_auto")).alias("origin"),
    )


@query
def scored_all(spark, sf_dir):
    return _scored_columns(scored(spark, sf_dir))


@query
def scored_own_sector(spark, sf_dir):
    return _scored_columns(score(stocks(spark, sf_dir), CFG, AS_OF, peer_by="sector"))


_VIEWS = replace(CFG, selected_sector="Utilities", search="ring")


@query
def peer_sets(spark, sf_dir):
    """Percentiles and medians in all five peer sets from one ranking."""
    rows = in_peer_sets(stocks(spark, sf_dir), views.peer_sets(_VIEWS))
    return with_peer_stats(rows, peer_by="peer").select("symbol", "peer_set", "median_pe", "pe_percentile")


@query
def scored_for_views(spark, sf_dir):
    df = views.scored_for_views(stocks(spark, sf_dir), _VIEWS, AS_OF)
    return df.select("symbol", "peer_set", "status", "short_score", "sector_premium", "value_trap")


@query
def rescored_changes(spark, sf_dir):
    """Scores after edits of a price, of a growth rate, and of the universe: only what they touch is worked out."""
    old = stocks(spark, sf_dir)
    new = _edited(old)
    scores = store(_scored_columns(score(old, CFG, AS_OF, peer_by="sector")), "scores")
    return changes.rescored(scores, old, new, CFG, AS_OF).select("symbol", "status", "pe_percentile", "short_score", "sector_premium")


def _edited(old: DataFrame) -> DataFrame:
    """Energy has other prices, one in five financials another growth, and one in seven utilities is gone."""
    c, turn = F.col, F.col("ordinal")
    gone = (c("sector") == "Utilities") & (turn % 7 == 0)
    rows = old.where(~gone)
    return rows.withColumns(
        {
            "price": F.when((c("sector") == "Energy") & (turn % 2 == 0), c("price") * 1.25).otherwise(c("price")),
            "eps_growth": F.when((c("sector") == "Financials") & (turn % 5 == 0), F.lit(21.0)).otherwise(c("eps_growth")),
        }
    )


@query
def stock_changes(spark, sf_dir):
    old = stocks(spark, sf_dir)
    new = _edited(old.where("ordinal % 11 <> 3"))
    return changes.row_changes(old.where("ordinal % 11 <> 4"), new)


@query
def sketch_medians(spark, sf_dir):
    """Medians per sector from sketches of parts of the table, merged; are they within the stated error of rank?"""
    c = F.col
    rows = stocks(spark, sf_dir).select("sector", V.current_pe(c("price"), c("forward_eps")).alias("pe"), (c("ordinal") % 7).alias("file"))
    kept = store(sketches.value_sketches(rows, "pe", "sector", "file"), "sketches")
    found = sketches.quantile(sketches.merged_sketches(kept, "sector"), 0.5)
    placed = rows.where("pe is not null").join(found, "sector").groupBy("sector", "n").agg(
        F.avg((c("pe") < c("median")).cast("double")).alias("below"), F.avg((c("pe") <= c("median")).cast("double")).alias("upto")
    )
    miss = F.greatest(c("below") - 0.5, F.lit(0.5) - c("upto"))
    return placed.select("sector", "n", (miss <= sketches.RANK_ERROR).alias("within_bound"))


def _scored_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "symbol",
        "current_pe",
        "upside",
        "required_growth",
        "sector_premium",
        "risk_score",
        "status",
        "pe_percentile",
        "peg",
        "growth_gap",
        "confidence",
        "short_score",
        "value_trap",
        "return_h",
        "range_position",
        "earnings_days",
    )


# Views --------------------------------------------------------------------------------------


@query
def visible(spark, sf_dir):
    cfg = replace(CFG, selected_sector="Energy", search=" RED ")
    return views.searched(stocks(spark, sf_dir), cfg).select("symbol", "name", "sector")


@query
def search_postings(spark, sf_dir):
    """Searches for one, two and more characters through the table of trigrams."""
    table = stocks(spark, sf_dir)
    grams = search.write_postings(table)
    found = None
    for needle in ("7", "ed", " RING ", "e b"):
        rows = search.search(table, grams, needle).select(F.lit(needle).alias("needle"), "symbol")
        found = rows if found is None else found.unionByName(rows)
    return found


@query
def status_filter(spark, sf_dir):
    cfg = replace(CFG, search="ring", status_filter="Overvalued")
    return views.with_status(stocks(spark, sf_dir), cfg, AS_OF).select("symbol", "name", "price")


@query
def status_filter_sector(spark, sf_dir):
    cfg = replace(CFG, selected_sector="Health Care", search="ring", status_filter="Very undervalued")
    return views.with_status(stocks(spark, sf_dir), cfg, AS_OF).select("symbol", "name", "price")


@query
def sorted_screen(spark, sf_dir):
    cfg = replace(CFG, sort_key="currentPE", sort_descending=True)
    return views.sorted_screen(stocks(spark, sf_dir), cfg, AS_OF).select("symbol", "current_pe")


def _positions(spark, sf_dir, cfg: ScreenConfig, *columns: str) -> DataFrame:
    """The whole sorted list with each row's place in it: rows before its part of the sorted,
    written table, of which there is one number for each part, plus its place there."""
    scored_rows = views.screen(stocks(spark, sf_dir), cfg, AS_OF)
    ordered = scored_rows.orderBy(*views.sort_columns(scored_rows, cfg)).select("symbol", *columns)
    numbered = store(ordered.withColumn("n", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("n", 33)
    parts = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))
    placed = numbered.withColumn("part", part).join(starts, "part")
    return placed.select("symbol", *columns, (F.col("before") + F.col("n").bitwiseAND((1 << 33) - 1)).alias("position"))


@query
def sorted_by_date(spark, sf_dir):
    return _positions(spark, sf_dir, replace(CFG, sort_key="nextEarningsDate"), "next_earnings_date")


@query
def sorted_by_text(spark, sf_dir):
    cfg = replace(CFG, sort_key="statusClass", sort_descending=True)
    return _positions(spark, sf_dir, cfg, "status")


@query
def sorted_by_flag(spark, sf_dir):
    """Flags are all equal as sort keys, so the list stays in input order."""
    return _positions(spark, sf_dir, replace(CFG, sort_key="isCustom", sort_descending=True))


@query
def sorted_by_number(spark, sf_dir):
    cfg = replace(CFG, sort_key="drawdown52High", search="e", status_filter="Very overvalued")
    return _positions(spark, sf_dir, cfg, "drawdown52_high")


@query
def screen_status(spark, sf_dir):
    """Judged among the rows found, scored among all."""
    cfg = replace(CFG, search="ring", status_filter="Overvalued")
    return views.screen(stocks(spark, sf_dir), cfg, AS_OF).select("symbol", "status", "pe_percentile", "short_score")


@query
def top30_status(spark, sf_dir):
    return views.compact_list(stocks(spark, sf_dir), replace(CFG, status_filter="Very undervalued"), AS_OF)


@query
def table_status_sector(spark, sf_dir):
    cfg = replace(CFG, selected_sector="Health Care", search="ring", status_filter="Very undervalued")
    return views.screen_table(stocks(spark, sf_dir), cfg, AS_OF).select("symbol", "name", "pe_percentile", "upside", "status_label")


@query
def sector_counts(spark, sf_dir):
    return views.sector_counts(stocks(spark, sf_dir))


@query
def todays_picks(spark, sf_dir):
    return views.todays_picks(stocks(spark, sf_dir), CFG, AS_OF)


@query
def sector_heatmap(spark, sf_dir):
    """Flagship: bars to metrics to stocks to own-sector scores to sectors."""
    priced = store(B.stocks_from_bars(spark, sf_dir), "stocks-from-bars")
    return views.sector_heatmap(priced, CFG, AS_OF)


@query
def sector_heatmap_stored(spark, sf_dir):
    return views.sector_heatmap(stocks(spark, sf_dir), CFG, AS_OF)


@query
def signals(spark, sf_dir):
    cfg = replace(CFG, selected_sector="Utilities")
    return views.signals(stocks(spark, sf_dir), cfg, AS_OF)


@query
def earnings_alerts(spark, sf_dir):
    return views.earnings_alerts(stocks(spark, sf_dir), CFG, AS_OF)


@query
def risk_alerts(spark, sf_dir):
    return views.risk_alerts(stocks(spark, sf_dir), CFG, AS_OF)


@query
def top30(spark, sf_dir):
    cfg = replace(CFG, search="b")
    return views.compact_list(stocks(spark, sf_dir), cfg, AS_OF)


@query
def screen_table(spark, sf_dir):
    return views.screen_table(stocks(spark, sf_dir), CFG, AS_OF)


@query
def summary_cards(spark, sf_dir):
    return views.summary_cards(stocks(spark, sf_dir), CFG, AS_OF)


@query
def stock_detail(spark, sf_dir):
    detail = views.stock_detail(stocks(spark, sf_dir), "p-11", CFG, AS_OF)
    return _scored_columns(detail).drop("earnings_days")


@query
def top8(spark, sf_dir):
    return views.extremes_top(stocks(spark, sf_dir), CFG, AS_OF)


@query
def trap4(spark, sf_dir):
    return views.extremes_traps(stocks(spark, sf_dir), CFG, AS_OF)


@query
def watchlist_top(spark, sf_dir):
    return views.watchlist_top(stocks(spark, sf_dir), CFG, AS_OF)


# Files --------------------------------------------------------------------------------------


def _csv(df: DataFrame, label: str) -> str:
    path = new_path(df.sparkSession, label)
    df.write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")
    return path


@query
def constituents_csv(spark, sf_dir):
    """Written and read back, with quotes, commas and line breaks in names."""
    odd = F.when(F.col("size") % 3 == 0, F.concat(F.lit('The "'), "name", F.lit('", Inc.')))
    odd = odd.when(F.col("size") % 3 == 1, F.concat("name", F.lit("\nplc"))).otherwise(F.col("name"))
    table = B.fund(spark, sf_dir).select(
        F.col("symbol").alias("Symbol"),
        odd.alias("Security"),
        F.col("sector").alias("GICS Sector"),
        F.col("sub_industry").alias("GICS Sub-Industry"),
        F.col("ordinal"),
    )
    return files.read_constituents(spark, _csv(table, "constituents"), multi_line=True)


@query
def tickers_csv(spark, sf_dir):
    """The best alias decides, not the first column."""
    table = B.fund(spark, sf_dir).select(
        F.col("sub_industry").alias("Industry"),
        F.lit("ignored").alias("ticker"),
        F.col("symbol").alias("SYMBOL"),
        F.when(F.col("size") % 2 == 0, F.col("name")).otherwise("").alias("회사명"),
        F.when(F.col("size") % 5 == 0, F.col("sector")).otherwise("").alias("GICS Sector"),
        "ordinal",
    )
    return files.read_tickers(spark, _csv(table, "tickers"))


@query
def fund_snapshot_csv(spark, sf_dir):
    path = _csv(B.fund_text(spark, sf_dir), "fundamentals")
    return snapshots.resolve_fund_snapshot(files.read_csv(spark, path)).drop("has_source")


@query
def import_csv(spark, sf_dir):
    table = B.fund(spark, sf_dir).select(
        F.col("symbol").alias("Ticker"),
        F.col("name").alias("Company"),
        F.lit("Materials").alias("Sector"),
        F.col("ordinal"),
    )
    old = stocks(spark, sf_dir).where("sector <> 'Energy'")
    raw = files.read_csv(spark, _csv(table, "import"))
    return files.import_constituents(raw, old).select(*_CARRIED, "sub_industry")


@query
def csv_rejects(spark, sf_dir):
    """Every line of a file is a good row or a rejected one with its reason."""
    key = F.col("ordinal")
    cells = F.concat_ws(",", "symbol", F.concat(F.lit('"'), F.col("name"), F.lit(', Inc."')), "sector")
    line = (
        F.when(key % 11 == 0, F.concat_ws(",", "symbol", "name"))
        .when(key % 11 == 1, F.concat(cells, F.lit(",more")))
        .when(key % 11 == 2, F.lit(' ,"",'))
        .otherwise(cells)
    )
    path = new_path(spark, "lines")
    B.fund(spark, sf_dir).select(line).write.text(path)
    good, rejected = rejects.read_csv_checked(spark, path, ["symbol", "name", "sector"])
    kept = good.select("symbol", "name", "sector", F.lit("").alias("reason"), F.lit("").alias("line"))
    return kept.unionByName(rejected.select("reason", "line"), allowMissingColumns=True)


@query
def required_rows(spark, sf_dir):
    """What a job says of a result with rows and of one without."""
    rows = B.fund(spark, sf_dir)
    n = files.require_rows(rows, "prices").count()
    try:
        said = str(files.require_rows(rows.where("price < 0"), "prices"))
    except RuntimeError as error:
        said = str(error)
    return rows.agg(F.lit(n).alias("n"), F.lit(said).alias("said"))


@query
def stock_json_roundtrip(spark, sf_dir):
    path = new_path(spark, "stock-json")
    files.write_stocks(stocks(spark, sf_dir), path)
    return files.read_stocks(spark, path).select(*_CARRIED, "ordinal")


@query
def state_json_roundtrip(spark, sf_dir):
    """Stocks and settings in one document under the reference's names, and back."""
    path = new_path(spark, "state")
    cfg = replace(CFG, analysis_mode="1y", overvalued_threshold=-12.5)
    state.write_state(stocks(spark, sf_dir), cfg, path)
    read, settings = state.read_state_parts(spark, path)
    known, unknown = state.settings_of(settings)
    if known != cfg or unknown:
        raise ValueError(f"settings were not kept: {known}, {unknown}")
    rows = read.withColumn("threshold", F.lit(known.overvalued_threshold))
    return rows.select(*_CARRIED, "threshold")


@query
def prices_csv_roundtrip(spark, sf_dir):
    path = new_path(spark, "prices")
    written = bar_ops.eod_metrics(B.bars_short(spark, sf_dir), AT)
    files.write_prices(files.require_rows(written, "prices"), path)
    return snapshots.resolve_price_snapshot(files.read_csv(spark, path)).drop("ordinal")


@query
def fundamentals_csv_roundtrip(spark, sf_dir):
    path = new_path(spark, "fundamentals")
    rows = B.fund(spark, sf_dir).select("symbol", F.col("forward_eps").alias("forwardEps"), "sector")
    files.write_fundamentals(rows, path)
    return files.read_csv(spark, path).select("symbol", "sector", "forwardEps", "beta", "error")

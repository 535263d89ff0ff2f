"""The test tables seen as the screen's inputs.

Suppliers (long histories) and parts (short ones) play the symbols, line items their bars,
part attributes the universe and the fundamentals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickersieve.config import ScreenConfig
from tickersieve.operators.bars import eod_metrics
from tickersieve.operators.universe import stacked
from tickersieve.plans.jobs import build_stocks

AS_OF = "2001-11-04"
UPDATED_AT = "2001-11-04T21:00:00+00:00"
CONFIG = ScreenConfig()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(spark: SparkSession, sf_dir: str, key: str, prefix: str) -> DataFrame:
    day = F.dayofmonth("date")
    gap_day = F.col(key) % 28 + 1
    grouped = (
        table(spark, sf_dir, "lineitem")
        .groupBy(key, F.to_date("l_shipdate").alias("date"))
        .agg(F.max("l_extendedprice").alias("top"), F.sum("l_quantity").alias("quantity"))
    )
    return grouped.select(
        F.concat(F.lit(prefix), F.col(key)).alias("symbol"),
        "date",
        F.when(day != gap_day, F.col("top")).alias("close"),
        F.when((day != gap_day) & (day != 3), F.col("top") * 0.97).alias("adj_close"),
        F.when(~day.isin(2, 4), F.col("quantity")).alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir, "l_suppkey", "s-")


def bars_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir, "l_partkey", "p-")


def fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('p-', p_partkey) AS symbol",
        "p_name AS name",
        """coalesce(element_at(map('ECONOMY', 'Energy', 'LARGE', 'Financials', 'MEDIUM', 'Health Care',
           'PROMO', 'Information Technology', 'SMALL', 'Utilities'), p_type), 'Unmapped') AS sector""",
        "p_brand AS sub_industry",
        "p_partkey AS ordinal",
        "p_size AS size",
        "p_retailprice AS retail",
        "if(p_partkey % 17 = 0, NULL, p_retailprice) AS price",
        """if(p_partkey % 13 = 0, '', if(p_partkey % 19 = 0, '-2.5', string(p_size))) AS forward_eps""",
        "if(p_partkey % 3 = 0, '4.5', '') AS trailing_eps",
        """element_at(array('0.12', '12%', '1.5', '1.6', '', '-0.05', '0.02'),
           int(p_partkey % 7) + 1) AS revenue_growth""",
        "if(p_partkey % 11 = 0, '', concat('0.0', p_partkey % 10)) AS earnings_growth",
        "concat('0.', p_partkey % 9 + 1) AS gross_margins",
        "concat('0.', p_partkey % 4, '5') AS operating_margins",
        "string((p_partkey * 7) % 350) AS debt_to_equity",
        "concat('1.', p_partkey % 10) AS beta",
        "string((p_partkey * 3) % 140) AS forward_pe",
        f"""if(p_partkey % 5 = 0, '',
            string(date_add(date '{AS_OF}', int(p_partkey % 40 - 5)))) AS next_earnings_date""",
    )


_LISTED = ("symbol", "name", "sector", "sub_industry", "ordinal")


def _listed(spark: SparkSession, sf_dir: str, condition: Column) -> DataFrame:
    return fund(spark, sf_dir).where(condition).select(*_LISTED)


def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand but two, which only the watchlists hold."""
    return _listed(spark, sf_dir, ~F.col("sub_industry").isin("Brand#9", "Brand#19"))


def local_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, F.col("sub_industry").isin("Brand#7", "Brand#9"))


def shared_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partly the same stocks, in the other spelling and without names and sectors."""
    rows = _listed(spark, sf_dir, F.col("sub_industry").isin("Brand#7", "Brand#19", "Brand#20"))
    return rows.withColumns(
        {
            "symbol": F.concat(F.lit(" P."), F.substring("symbol", 3, 20)),
            "name": F.lit(""),
            "sector": F.lit(""),
        }
    )


def price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price snapshot as text cells: part prices with the indicators of their bars.

    Some closes are empty or '0', and parts of size 29 have a second, later row.
    """
    metrics = eod_metrics(bars_short(spark, sf_dir), UPDATED_AT, one_a_day=True)
    columns = ("return1m", "return3m", "return4m", "return6m", "high52", "low52", "range52")
    cells = metrics.select(
        "symbol",
        F.col("date").cast("string").alias("date"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns],
    )
    stocks = fund(spark, sf_dir).withColumn("key", F.upper(F.translate("symbol", "-", ".")))
    joined = stocks.join(cells.withColumnRenamed("symbol", "key"), "key", "left")
    once = joined.select(
        "symbol",
        F.coalesce("date", F.lit("")).alias("date"),
        F.when(F.col("ordinal") % 23 == 0, "0")
        .otherwise(F.coalesce(F.col("price").cast("string"), F.lit("")))
        .alias("close"),
        F.when(F.col("ordinal") % 2 == 0, F.col("retail").cast("string")).otherwise("").alias("adjClose"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in columns],
        F.lit("bars").alias("source"),
        F.lit(UPDATED_AT).alias("updatedAt"),
        "ordinal",
        "size",
        "price",
    )
    again = once.where("size = 29 and price is not null").withColumn(
        "close", (F.col("price") * 1.1).cast("string")
    )
    # Behind all other rows.
    behind = fund(spark, sf_dir).agg(F.max("ordinal") + 1).scalar()
    again = again.withColumn("ordinal", F.col("ordinal") + behind)
    return once.unionByName(again).drop("size", "price")


# Header spelling of the fundamentals file.
FUND_HEADER = {
    "symbol": "symbol",
    "forward_eps": "forwardEps",
    "trailing_eps": "trailingEps",
    "forward_pe": "forwardPE",
    "revenue_growth": "revenueGrowth",
    "earnings_growth": "earnings_growth",
    "gross_margins": "grossMargin",
    "operating_margins": "operatingMargins",
    "debt_to_equity": "debtToEquity",
    "beta": "Beta",
    "next_earnings_date": "earningsDate",
}


def fund_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fundamentals snapshot as text cells, under several header spellings."""
    stamp = F.when(
        F.col("ordinal") % 10 == 0,
        (F.lit(1004832000) + F.col("ordinal") % 30 * 86400).cast("string"),
    ).otherwise("")
    return fund(spark, sf_dir).select(
        *[F.col(k).alias(v) for k, v in FUND_HEADER.items()],
        stamp.alias("earningsTimestamp"),
        F.lit("records").alias("source"),
        F.lit(UPDATED_AT).alias("updatedAt"),
        "ordinal",
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User edits of some sizes; later edits of a field replace earlier ones."""
    key, size = F.col("ordinal"), F.col("size")

    def edit(when: Column, field: str, value: Column, at: int) -> Column:
        return F.when(
            when,
            F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(at).alias("ordinal")),
        )

    number = (key % 50 + 1).cast("string")
    edits = F.array_compact(
        F.array(
            edit(size == 31, "price", F.concat(number, F.lit(" USD")), 1),
            edit(size == 31, "price", number, 2),
            edit(size == 37, "epsGrowth", number, 1),
            edit(size == 38, "forwardEPS", F.lit("n/a"), 1),
            edit(size == 41, "risk.cyc", F.lit("4.9"), 1),
            edit(size.isin(37, 42), "discountRate", F.lit("12.5"), 2),
        )
    )
    return fund(spark, sf_dir).select("symbol", F.inline(edits))


def universe_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Constituents and the two watchlists as one, local entries first."""
    lists = stacked(local_list(spark, sf_dir), shared_list(spark, sf_dir)).drop("_source")
    return constituents(spark, sf_dir), lists


def stocks(
    spark: SparkSession,
    sf_dir: str,
    cfg: ScreenConfig = CONFIG,
    with_overrides: bool = False,
) -> DataFrame:
    """The merged stock table that most views read."""
    listed, lists = universe_lists(spark, sf_dir)
    return build_stocks(
        listed,
        lists,
        price_text(spark, sf_dir),
        fund_text(spark, sf_dir),
        cfg,
        overrides(spark, sf_dir) if with_overrides else None,
    )


def stocks_from_bars(spark: SparkSession, sf_dir: str, cfg: ScreenConfig = CONFIG) -> DataFrame:
    """The stock table priced by the last close of its bars."""
    listed, lists = universe_lists(spark, sf_dir)
    metrics = eod_metrics(bars_short(spark, sf_dir), UPDATED_AT, one_a_day=True)
    prices = metrics.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in metrics.columns],
        F.lit(0).alias("ordinal"),
    )
    return build_stocks(listed, lists, prices, fund_text(spark, sf_dir), cfg)

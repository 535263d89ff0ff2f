"""Substring search over very many stocks by a table of trigrams.

Every position of a text gives the three characters from there on, with padding behind the end, so each substring of
up to three characters begins some trigram, and a longer one has all its trigrams in the texts that hold it. The
table is written in the order of trigrams: a search reads the row groups that can hold its own. Rows that
have them all are few and are checked on the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersieve.functions.text import matches_search
from tickersieve.sources.store import store

COLUMNS = ("symbol", "name", "sector", "sub_industry")
_PAD = "\x00\x00"


def postings(stocks: DataFrame) -> DataFrame:
    """gram and symbol, one row each, for a table sorted by gram."""
    texts = F.array_compact(F.array(*[F.lower(c) for c in COLUMNS]))
    grams = F.flatten(
        F.transform(
            F.filter(texts, lambda t: t != ""),
            lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(F.concat(t, F.lit(_PAD)), i, F.lit(3))),
        )
    )
    return stocks.select("symbol", F.explode(F.array_distinct(grams)).alias("gram"))


def write_postings(stocks: DataFrame) -> DataFrame:
    return store(postings(stocks).repartitionByRange("gram").sortWithinPartitions("gram", "symbol"), "postings")


def search(stocks: DataFrame, grams: DataFrame, query: str) -> DataFrame:
    """The stocks that `matches_search` finds in COLUMNS, through the table of trigrams."""
    needle = query.strip().lower()
    if not needle:
        return stocks
    if len(needle) < 3:
        likely = grams.where(F.startswith("gram", F.lit(needle))).select("symbol").distinct()
    else:
        wanted = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
        hits = grams.where(F.col("gram").isin(wanted)).groupBy("symbol").agg(F.count("*").alias("n"))
        likely = hits.where(F.col("n") == len(wanted)).select("symbol")
    return stocks.join(likely, "symbol", "left_semi").where(matches_search(query, *[F.col(c) for c in COLUMNS]))

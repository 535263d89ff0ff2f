"""Small tables with the awkward rows that every corpus operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, rows: list[tuple[int | None, str | None]], parts: int = 3) -> DataFrame:
    full = [(i, t, None if k % 5 == 0 else "en", "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, no letters, and columns
    whose names operators use inside."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "12 34 !!", "de", None, 8),
        (5, "one two three four", "en", "s", 18), (5, "one two three four", "en", "s", 18), (5, "another text under this id", "en", "s", None),
        (6, "lång " * 3000, None, "s", 15000), (7, "x" * 60000, "fr", "s", 60000), (8, "one two three four", "en", "s", 18),
        (9, "a b c d e f g h\n" * 40, "en", "s", 640), (10, "a b c d e f g h\n" * 41, "en", "s", 656), (None, "nobody's text", "en", "s", 13), (None, None, None, None, None),
    ]
    from pyspark.sql import functions as F

    out = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return out.withColumns({c: F.lit(7) for c in ("text_key", "bucket", "key", "n", "first", "score", "n_removed", "ahead", "line", "token", "a", "b", "id", "h")})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def sentences(seed: int, n: int, vocabulary: int, words: tuple[int, int]) -> list[str]:
    pick = random.Random(seed)
    known = [f"w{k}" for k in range(vocabulary)]
    return [" ".join(pick.choices(known, k=pick.randrange(*words))) for _ in range(n)]


def edited(text: str, share: float, pick: random.Random) -> str:
    return " ".join(f"new{pick.randrange(10**6)}" if pick.random() < share else w for w in text.split())

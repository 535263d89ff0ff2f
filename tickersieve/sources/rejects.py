"""CSV rows with a check of their shape: rows that fit, and a table of those that don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickersieve.functions.numbers import strip
from tickersieve.sources.files import with_position
from tickersieve.sources.store import store

_LINE = "_line"


def read_csv_checked(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with as many cells as the header, and the rejected lines: `file, position, reason, line`.

    `position` (`ordinal` of good rows) orders lines by file and place. Blank lines are rejected as blank;
    Spark itself skips empty ones. Without `names` of the columns, all files need the header of the first. The files are
    parsed once, into a stored table."""
    header = names is None
    if names is None:
        names = spark.read.csv(path, header=True).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _LINE]])
    read = spark.read.csv(
        path, schema=schema, header=header, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_LINE,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="\0", emptyValue="",
    )
    placed = store(with_position(read.withColumn("_from", F.input_file_name()), path, "ordinal"), "checked-csv")
    cells = F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names])
    blank = F.forall(cells, lambda c: strip(c) == "")
    fits = F.col(_LINE).isNull() & ~blank
    extra = F.size(F.filter(F.array(*[F.col(f"`{n}`").isNull() for n in names]), lambda c: c))
    reason = F.when(blank, "blank").when(extra > 0, "too few cells").otherwise("too many cells")
    good = placed.where(fits).select(*[F.coalesce(F.translate(f"`{n}`", "\r", ""), F.lit("")).alias(n) for n in names], "ordinal")
    rejected = placed.where(~fits).select(F.col("_from").alias("file"), F.col("ordinal").alias("position"), reason.alias("reason"), F.coalesce(_LINE, F.lit("")).alias("line"))
    return good, rejected

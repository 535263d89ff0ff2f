"""The screen's saved state: one JSON document of stocks and settings under camel-case names.

A state of any size is written as text parts in order, which make up the document when they are
put end to end; each stock is a line of its own, so that parts are read in parallel. A document in
a single file, indented or not, is read as a whole.
"""

from __future__ import annotations

import json
import logging
import re
from dataclasses import fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickersieve.config import RISK_FIELDS, ScreenConfig
from tickersieve.schemas import STOCK_COLUMNS, STOCK_SCHEMA
from tickersieve.sources.files import with_position

log = logging.getLogger(__name__)

# Names that do not follow from the column by camel case.
_ODD_NAMES = {"forward_eps": "forwardEPS", "exit_pe": "exitPE"}
_ODD_SETTINGS = {"default_eps": "defaultEPS"}
# Settings of the browser page that mean nothing here.
PAGE_SETTINGS = ("autoSave", "fmpApiKey", "useFmp", "watchlistSubmitUrl", "watchlistSheetCsvUrl")


def camel(name: str, odd: dict[str, str] = _ODD_NAMES) -> str:
    return odd.get(name) or re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


_COLUMNS = [c for c in STOCK_COLUMNS if c != "ordinal"]
_SETTINGS = {camel(f.name, _ODD_SETTINGS): f.name for f in fields(ScreenConfig) if f.name != "weights"}


def _state_type() -> T.StructType:
    kinds = {c: STOCK_SCHEMA[c].dataType for c in _COLUMNS}
    return T.StructType([T.StructField(camel(c), T.StringType() if isinstance(k, T.DateType) else k) for c, k in kinds.items()])


def _typed(stock: Column) -> list[Column]:
    out = []
    for c in _COLUMNS:
        value = stock[camel(c)]
        kind = STOCK_SCHEMA[c].dataType
        out.append((F.try_to_date(value) if isinstance(kind, T.DateType) else value.cast(kind)).alias(c))
    return out


def settings_of(saved: dict[str, Any], base: ScreenConfig = ScreenConfig()) -> tuple[ScreenConfig, list[str]]:
    """Saved settings over those of `base`, and the names of settings that are not known here."""
    known = {_SETTINGS.get(k, k): v for k, v in saved.items()}
    own = {f.name for f in fields(ScreenConfig)}
    unknown = sorted(k for k in known if k not in own and k not in PAGE_SETTINGS)
    unknown += sorted(f"weights.{k}" for k in (saved.get("weights") or {}) if k not in RISK_FIELDS)
    if unknown:
        log.warning("unknown settings are left out: %s", ", ".join(unknown))
    return base.merged_with(known), unknown


def settings_json(cfg: ScreenConfig) -> str:
    values = {name: getattr(cfg, own) for name, own in _SETTINGS.items()}
    return json.dumps({**values, "weights": {r: getattr(cfg.weights, r) for r in RISK_FIELDS}}, ensure_ascii=False)


def write_state(stocks: DataFrame, cfg: ScreenConfig, path: str) -> None:
    """Stocks in input order and all settings."""
    stock = F.to_json(
        F.struct(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(STOCK_SCHEMA[c].dataType, T.DateType) else F.col(c)).alias(camel(c)) for c in _COLUMNS]),
        {"ignoreNullFields": "false"},
    )
    first = stocks.agg(F.min("ordinal").alias("first")).scalar()
    comma = F.when(F.col("ordinal") == first, "").otherwise(",")
    lines = stocks.select(F.lit(1).alias("section"), "ordinal", F.concat(comma, stock).alias("line"))
    ends = stocks.sparkSession.createDataFrame(
        [(0, None, f'{{"settings":{settings_json(cfg)},"stocks":['), (2, None, "]}")], "section int, ordinal long, line string"
    )
    lines.unionByName(ends).orderBy("section", "ordinal").select("line").write.text(path)


def read_state_parts(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Any]]:
    """The stocks and settings of a folder that `write_state` made; ordinals keep their order."""
    lines = with_position(spark.read.text(path), path, "ordinal")
    head = lines.where(F.startswith("value", F.lit('{"settings":'))).first()
    settings = json.loads(head[0] + "]}")["settings"] if head else {}
    body = F.when(F.startswith("value", F.lit(",")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    stocks = lines.where(~F.startswith("value", F.lit('{"settings":')) & (F.col("value") != "]}"))
    parsed = stocks.select(F.from_json(body, _state_type()).alias("s"), "ordinal")
    return _rows(parsed), settings


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Any]]:
    """The stocks and settings of a document in a single file, as a browser saves it; one task reads it, so it
    must fit in one row (2 GB). What `write_state` wrote is read in parallel by `read_state_parts`."""
    text = spark.read.text(path, wholetext=True)
    kind = T.StructType([T.StructField("stocks", T.ArrayType(_state_type())), T.StructField("settings", T.StringType())])
    document = text.select(F.from_json("value", kind).alias("d"))
    found = document.select("d.settings").first()
    settings = json.loads(found[0]) if found and found[0] else {}
    return _rows(document.select(F.posexplode("d.stocks").alias("ordinal", "s"))), settings


def _rows(parsed: DataFrame) -> DataFrame:
    return parsed.select(*_typed(F.col("s")), F.col("ordinal").cast("long").alias("ordinal")).select(*STOCK_COLUMNS)

"""Building and refreshing the stock universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersieve.config import (
    FALLBACK_SECTOR,
    MISSING_SECTOR,
    RISK_FIELDS,
    SECTOR_DEFAULTS,
    SHARED_LIST_LABEL,
    SOURCE_MANUAL_PRICE,
    SOURCE_SECTOR_DEFAULT,
    SOURCE_SHARED_LIST,
    WATCHLIST_SECTOR,
)
from tickersieve.functions.numbers import blank_to_null, strip
from tickersieve.functions.symbols import normalize_symbol
from tickersieve.operators.rows import first_per_key, keep_by
from tickersieve.schemas import RISK_TYPE, STOCK_COLUMNS, STOCK_SCHEMA

def stacked(*sources: DataFrame) -> DataFrame:
    """Rows of all sources, with ordinals that put each source behind the ones before it.

    Ordinals are shifted by what the sources before actually use (one narrow aggregate each), so
    that the order never depends on how large they are. The first source keeps its ordinals.
    Adds `_source`.
    """
    merged, free = None, None
    for rank, source in enumerate(sources):
        ordinal = F.col("ordinal").cast("long")
        bounds = source.agg(F.min(ordinal).alias("low"), F.max(ordinal).alias("high"))
        if free is None:
            shifted = ordinal
            free = bounds.select(F.coalesce("high", F.lit(-1)) + 1).scalar()
        else:
            shifted = ordinal - bounds.select("low").scalar() + free
            free = free + bounds.select(F.coalesce(F.col("high") - F.col("low") + 1, F.lit(0))).scalar()
        rows = source.withColumns({"ordinal": shifted, "_source": F.lit(rank)})
        merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
    if merged is None:
        raise ValueError("at least one source is needed")
    return merged


def union_keep_first(*sources: DataFrame) -> DataFrame:
    """Rows of all sources, one per symbol: the earliest source wins, then the lowest ordinal.

    Blank symbols are dropped. The ordinals order the merged rows.
    """
    merged = stacked(*sources).withColumn("symbol", normalize_symbol(F.col("symbol")))
    named = merged.where(F.col("symbol") != "")
    return keep_by(named, "symbol", F.col("_source").asc(), F.col("ordinal").asc_nulls_last()).drop(
        "_source"
    )


_ASSUMPTIONS = ("eps_growth", "rev_growth", "gross_margin", "op_margin", "exit_pe", "discount_rate")


def _defaults_sql(values: tuple) -> str:
    def fields(names: tuple[str, ...], numbers: tuple) -> str:
        return ", ".join(f"'{n}', {float(v)}D" for n, v in zip(names, numbers))

    risk = f"named_struct({fields(RISK_FIELDS, values[6])})"
    return f"named_struct({fields(_ASSUMPTIONS, values[:6])}, 'risk', {risk})"


def sector_default(sector: str) -> Column:
    """Default assumptions for a sector column; a constant map, so no join is needed."""
    entries = ", ".join(f"'{name}', {_defaults_sql(v)}" for name, v in SECTOR_DEFAULTS.items())
    fallback = _defaults_sql(SECTOR_DEFAULTS[FALLBACK_SECTOR])
    return F.expr(f"coalesce(element_at(map({entries}), `{sector}`), {fallback})")


def with_sector_defaults(rows: DataFrame) -> DataFrame:
    """`symbol, name, sector, sub_industry, ordinal` rows to full stock rows.

    Columns that start with an underscore pass through.
    """
    known = set(rows.columns)
    helpers = [c for c in rows.columns if c.startswith("_")]

    def text(name: str) -> Column:
        return blank_to_null(F.col(name)) if name in known else F.lit(None).cast("string")

    base = rows.select(
        normalize_symbol(F.col("symbol")).alias("symbol"),
        strip(F.coalesce(text("name"), F.col("symbol"))).alias("name"),
        strip(F.coalesce(text("sector"), F.lit(MISSING_SECTOR))).alias("sector"),
        strip(F.coalesce(text("sub_industry"), F.lit(""))).alias("sub_industry"),
        F.col("ordinal").cast("long").alias("ordinal"),
        (F.col("is_custom") if "is_custom" in known else F.lit(None).cast("boolean")).alias(
            "is_custom"
        ),
        *helpers,
    ).withColumn("d", sector_default("sector"))
    filled = {
        "price_source": F.lit(SOURCE_MANUAL_PRICE),
        "notes": F.lit(""),
        "fundamental_source": F.lit(SOURCE_SECTOR_DEFAULT),
        "fundamental_auto": F.lit(False),
        "fundamental_manual": F.lit(False),
        "risk_auto": F.lit(False),
        "risk": F.col("d.risk").cast(RISK_TYPE),
    }
    filled.update({name: F.col(f"d.{name}") for name in _ASSUMPTIONS})
    own = set(base.columns)
    return base.select(
        *[
            F.col(f.name)
            if f.name in own
            else filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STOCK_SCHEMA.fields
        ],
        *helpers,
    )


_ROW = ("symbol", "name", "sector", "sub_industry", "ordinal")


def list_rows(rows: DataFrame) -> DataFrame:
    """Watchlist rows with list defaults for blank cells."""
    symbol = normalize_symbol(F.col("symbol"))
    defaults = {
        "name": symbol,
        "sector": F.lit(WATCHLIST_SECTOR),
        "sub_industry": F.lit(SHARED_LIST_LABEL),
    }
    return rows.withColumns(
        {c: F.coalesce(blank_to_null(F.col(c)), default) for c, default in defaults.items()}
    ).select(*_ROW)


def shared_list_stocks(rows: DataFrame) -> DataFrame:
    """Watchlist rows to stock rows, marked as the user's own, one per symbol."""
    return _as_custom(with_sector_defaults(union_keep_first(list_rows(rows)))).withColumn(
        "fundamental_source", F.lit(SOURCE_SHARED_LIST)
    )


# Columns that an older row keeps even if it has none, and those it keeps if it has one.
_ALWAYS_OLD = ("price", "price_source", "forward_eps")
_OLD_OR_NEW = (
    "rev_growth",
    "eps_growth",
    "gross_margin",
    "op_margin",
    "exit_pe",
    "discount_rate",
    "risk",
    "notes",
    "fundamental_source",
    "fundamental_auto",
    "fundamental_manual",
    "return1m",
    "return3m",
    "return4m",
    "return6m",
    "is_custom",
    "risk_auto",  # kept with the risk scores it describes
)


def carry_forward(new: DataFrame, old: DataFrame, whole: Column | None = None) -> DataFrame:
    """New stock rows with the prices and assumptions of the old rows of the same symbol.

    52-week values and earnings dates are not carried, except for rows where `whole` holds:
    these become their old rows. `old` has one row per symbol.
    """
    previous = old.select(
        "symbol",
        F.lit(True).alias("_known"),
        *[F.col(c).alias(f"_old_{c}") for c in STOCK_COLUMNS if c != "symbol"],
    )
    missing = {"notes": "", "fundamental_auto": False, "fundamental_manual": False}
    updated = {}
    for name in STOCK_COLUMNS:
        kept, own = F.col(f"_old_{name}"), F.col(name)
        if name in _ALWAYS_OLD:
            updated[name] = F.when(F.col("_known"), kept).otherwise(own)
        elif name in missing:
            default = F.coalesce(kept, F.lit(missing[name]))
            updated[name] = F.when(F.col("_known"), default).otherwise(own)
        elif name == "is_custom":
            flag = F.coalesce(kept, own, F.lit(False))
            updated[name] = F.when(F.col("_known"), flag).otherwise(own)
        elif name in _OLD_OR_NEW:
            updated[name] = F.coalesce(kept, own)
        if whole is not None and name not in ("symbol", "ordinal"):
            updated[name] = F.when(whole, kept).otherwise(updated.get(name, own))
    helpers = [c for c in new.columns if c.startswith("_")]
    joined = new.join(previous, "symbol", "left")
    return joined.withColumns(updated).select(*STOCK_COLUMNS, *helpers)


def is_watched() -> Column:
    return F.coalesce(F.col("is_custom"), F.lit(False)) | F.coalesce(
        F.col("sector") == WATCHLIST_SECTOR, F.lit(False)
    )


def _as_custom(stocks: DataFrame, own: Column | None = None) -> DataFrame:
    """Mark the user's own stocks (default: all rows) and file unsorted ones as watched."""
    own = F.lit(True) if own is None else own
    unsorted_sector = F.col("sector").isNull() | F.col("sector").isin("", MISSING_SECTOR)
    return stocks.withColumns(
        {
            "is_custom": F.when(own, True).otherwise(F.col("is_custom")),
            "sector": F.when(own & unsorted_sector, WATCHLIST_SECTOR).otherwise(F.col("sector")),
        }
    )


def refresh_universe(
    constituents: DataFrame, shared: DataFrame, old: DataFrame | None = None
) -> DataFrame:
    """Constituents, then the user's own stocks (old ones, then shared lists), one per symbol.

    `constituents` and `shared` are raw rows, `old` is the stock table being refreshed. Only
    the narrow raw rows are shuffled to choose one per symbol; defaults are filled in after
    that and the old table joins on the same partitioning.
    """
    sources = {"listed": constituents.select(*_ROW)}
    if old is not None:
        sources["old"] = old.where(is_watched()).select(*_ROW)
    sources["list"] = list_rows(shared)
    rows = union_keep_first(*[df.withColumn("_origin", F.lit(o)) for o, df in sources.items()])
    own = F.col("_origin") != "listed"
    source = F.when(F.col("_origin") == "list", SOURCE_SHARED_LIST)
    stocks = with_sector_defaults(rows).withColumns(
        {
            "is_custom": F.when(own, True),
            "fundamental_source": F.coalesce(source, F.col("fundamental_source")),
        }
    )
    if old is not None:
        stocks = carry_forward(stocks, old, whole=F.col("_origin") == "old")
    return _as_custom(stocks, own).select(*STOCK_COLUMNS)


def _after(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows with ordinals behind those of a stored table."""
    last = existing.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("last")).scalar()
    return rows.withColumn("ordinal", F.col("ordinal") + last + 1)


def sync_watchlist(existing: DataFrame, shared: DataFrame) -> DataFrame:
    """Existing stocks untouched, plus the shared rows with new symbols at the end."""
    added = shared_list_stocks(shared).join(existing.select("symbol"), "symbol", "left_anti")
    return existing.unionByName(_after(added, existing).select(*existing.columns))


def only_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose symbol is wanted, with normalised symbols.

    The join is on the symbol itself, so a shuffled join leaves the rows partitioned for the
    per-symbol operators that follow.
    """
    symbols = wanted.select(normalize_symbol(F.col("symbol")).alias("symbol"))
    keyed = rows.withColumn("symbol", normalize_symbol(F.col("symbol")))
    return keyed.join(symbols, "symbol", "left_semi").select(*rows.columns)


def watchlist_additions(
    candidates: DataFrame, existing: DataFrame, added_at: str, source: str
) -> DataFrame:
    """Rows to append to a shared watchlist; symbols that already exist are rejected."""
    clean = candidates.select(
        normalize_symbol(F.col("symbol")).alias("symbol"),
        strip(F.col("name")).alias("name"),
        F.coalesce(blank_to_null(F.col("sector")), F.lit(WATCHLIST_SECTOR)).alias("sector"),
        F.coalesce(blank_to_null(strip(F.col("sub_industry"))), F.lit(SHARED_LIST_LABEL)).alias(
            "sub_industry"
        ),
        F.col("ordinal"),
    ).where("symbol != ''")
    known = existing.select(normalize_symbol(F.col("symbol")).alias("symbol"))
    return first_per_key(clean.join(known, "symbol", "left_anti"), "symbol").select(
        "symbol",
        F.coalesce(blank_to_null(F.col("name")), F.col("symbol")).alias("name"),
        "sector",
        "sub_industry",
        F.lit(added_at).alias("added_at"),
        F.lit(source).alias("source"),
    )


def coverage_gaps(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    """Wanted symbols without usable prices, with the reason."""
    fields = [c for c in ("close", "adj_close", "volume") if c in bars.columns]
    has_close = "close" in bars.columns
    any_value = F.coalesce(*[F.col(c).cast("double") for c in fields]).isNotNull()
    seen = (
        bars.where(any_value)
        .groupBy(normalize_symbol(F.col("symbol")).alias("symbol"))
        .agg((F.count("close") if has_close else F.lit(0)).alias("valid"))
    )
    names = wanted.select(normalize_symbol(F.col("symbol")).alias("symbol")).distinct()
    reason = (
        F.when(F.col("valid").isNull(), "no usable price")
        .when(F.lit(not has_close), "no Close column")
        .when(F.col("valid") == 0, "no valid close")
    )
    return (
        names.where("symbol != ''")
        .join(seen, "symbol", "left")
        .select("symbol", reason.alias("reason"))
        .where("reason is not null")
    )

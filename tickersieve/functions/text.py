"""Labels, display numbers and search."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickersieve.config import MISSING_SECTOR, MISSING_TEXT, SECTOR_LABELS, STATUS_LABELS
from tickersieve.functions.numbers import blank_to_null, finite


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for x in chain.from_iterable(table.items())]
    return F.element_at(F.create_map(*pairs), key)


def sector_label(sector: Column) -> Column:
    return F.coalesce(
        _lookup(SECTOR_LABELS, sector), blank_to_null(sector), F.lit(SECTOR_LABELS[MISSING_SECTOR])
    )


def status_label(status: Column) -> Column:
    return F.coalesce(_lookup(STATUS_LABELS, status), status)


def _ties_away_from_zero(number: Column, digits: int) -> Column:
    """Nudge exact decimal ties outward, since format_number rounds them to even.

    A double is such a tie only if number * 2^(digits+1) is an odd integer.
    """
    scaled = F.abs(number) * float(2 ** (digits + 1))
    is_tie = (scaled < 2.0**53) & (scaled == F.floor(scaled)) & (scaled % 2.0 == 1.0)
    return F.when(is_tie, number * (1.0 + 2.0**-52)).otherwise(number)


def percent_text(ratio: Column, digits: int = 1) -> Column:
    value = finite(ratio) * 100.0
    shown = F.translate(F.format_number(_ties_away_from_zero(value, digits), digits), ",", "")
    return F.coalesce(F.concat(shown, F.lit("%")), F.lit(MISSING_TEXT))


def number_text(number: Column, digits: int = 1) -> Column:
    """Grouped thousands, fixed decimals, rounded half up on the shortest decimal form."""
    shown = F.format_number(F.round(finite(number), digits), digits)
    return F.coalesce(shown, F.lit(MISSING_TEXT))


def money_text(number: Column) -> Column:
    shown = F.format_number(F.round(finite(number), 2), 2)
    return F.coalesce(F.concat(F.lit("$"), shown), F.lit(MISSING_TEXT))


def matches_search(query: str, *columns: Column) -> Column:
    """True when any column contains the query, ignoring case."""
    needle = query.strip().lower()
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(column), F.lit(needle)), F.lit(False))
    return hit if needle else F.lit(True)

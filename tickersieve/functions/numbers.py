"""Number parsing, guards and clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = " \t\n\r\f\v\u00a0\ufeff"
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_BLANKS = r"[\s\u00a0\ufeff]*"
_WHOLE_NUMBER = f"^{_BLANKS}({_NUMBER}){_BLANKS}$"
_NUMBER_PREFIX = f"^{_BLANKS}({_NUMBER})"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def finite(number: Column) -> Column:
    """NULL for NaN and infinities (NaN sorts above every number in Spark)."""
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def parse_strict(text: Column, blank: str = "null") -> Column:
    """A finite number only if the whole trimmed text is one; '' is NULL or 0."""
    number = finite(F.regexp_extract(text, _WHOLE_NUMBER, 1).try_cast("double"))
    return F.when(strip(text) == "", 0.0).otherwise(number) if blank == "zero" else number


def parse_loose(text: Column, blank: str = "null") -> Column:
    """As parse_strict, after removing percent signs, commas and dollar signs."""
    return parse_strict(F.translate(text.cast("string"), "%,$", ""), blank)


def parse_prefix(text: Column) -> Column:
    """The number a text starts with: '12abc' is 12."""
    return finite(F.regexp_extract(text.cast("string"), _NUMBER_PREFIX, 1).try_cast("double"))


def percent_points(number: Column) -> Column:
    """Ratios up to 1.5 become percentages; larger values already are."""
    return F.when(F.abs(number) <= 1.5, number * 100.0).otherwise(number)


def percent_from_text(text: Column, blank: str = "null") -> Column:
    return percent_points(parse_loose(text, blank))


def clamp_or(number: Column, default: float, low: float = 0.0, high: float = 100.0) -> Column:
    """Within the limits; a missing number counts as the default."""
    present = F.coalesce(number, F.lit(float(default)))
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), present))


def clamp(number: Column, low: float, high: float) -> Column:
    """NULL stays NULL, unlike bare greatest/least."""
    return F.when(
        number.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number))
    )


def truthy(number: Column) -> Column:
    """Present and not zero; never NULL itself."""
    return F.coalesce(number, F.lit(0.0)) != 0.0


def positive(number: Column) -> Column:
    """Greater than zero; false (not NULL) when missing."""
    return F.coalesce(number > 0.0, F.lit(False))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def first_present(*texts: Column) -> Column:
    """First text that is neither NULL nor empty; '0' counts as present."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


def steps(value: Column, ladder: list[tuple[Column, float | str]], otherwise: object) -> Column:
    """First matching rung of a ladder of conditions; NULL value gives NULL."""
    chain = F.when(value.isNull(), F.lit(None))
    for condition, result in ladder:
        chain = chain.when(condition, F.lit(result))
    return chain.otherwise(F.lit(otherwise))

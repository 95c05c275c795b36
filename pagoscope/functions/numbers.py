"""Number helpers (B4, B5, B14-B16, B20); SQL texts unless Columns are named."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagoscope.functions.text import literal, strip

# Fixed value: the number texts accepted in an amount. Type suffixes ("1.0d"),
# hexadecimal floats and digit separators ("1_000") are not numbers.
NUMBER_SHAPE = (
    r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
)


def parse_number(text: str) -> str:
    """Text to double, NULL when it is not a number; ``nan`` stays NaN."""
    tidy = strip(text)
    return (
        f"CASE WHEN rlike({tidy}, {literal(NUMBER_SHAPE)})"
        f" THEN try_cast({tidy} AS DOUBLE) END"
    )


def nan_to_null(number: str) -> str:
    """The coercing reading, in which NaN counts as missing."""
    return f"nullif({number}, double('NaN'))"


def half_even_int(number: str) -> str:
    """banker's rounding to INT, for scores."""
    return f"CAST(bround({number}, 0) AS INT)"


def clamp(number: str, low: int, high: int) -> str:
    """Limit to ``low..high``."""
    return f"greatest({low}, least({high}, {number}))"


def ratio(part: str, whole: str) -> str:
    """``part / whole`` as double, NULL (not an error) for an empty whole."""
    return f"try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE))"


def percent(part: str, whole: str) -> str:
    """Percentage to one digit, 0.0 for an empty whole."""
    return f"coalesce(bround({ratio(part, whole)} * 100, 1), 0D)"


def half_even(value: Column, digits: int = 0) -> Column:
    """B14 on a Column."""
    return F.bround(value, digits)


def thousands(value: Column, digits: int = 0) -> Column:
    """B16 on a Column: fixed digits with thousands separators."""
    shown = F.format_number(value, digits)
    infinite = F.lit(float("inf"))
    return F.when(value == infinite, "inf").when(value == -infinite, "-inf").otherwise(shown)

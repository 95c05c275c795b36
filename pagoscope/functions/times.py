"""Time helpers (B6, B7, B21). The session time zone is expected to be UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from pagoscope.functions.text import literal

# Formats tried, in this order, after the ISO forms that Spark
# reads by itself. Narrower than a guessing parser, and the same on every run.
# Each entry is one pattern; its optional sections exclude each other.
TIMESTAMP_FORMATS = (
    "[yyyyMMdd][yyyy/M/d[ H:mm:ss]][M/d/yyyy[ H:mm:ss]][d-M-yyyy[ H:mm:ss]]"
    "[d MMM yyyy[ H:mm:ss]][MMM d, yyyy[ H:mm:ss]]",
    "d/M/yyyy[ H:mm:ss]",
)
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"


def parse_timestamp(text: str, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> str:
    """SQL text that reads a timestamp leniently, NULL when nothing fits.

    A time without a date is invalid: its value would depend on the day of the run.
    ``coalesce`` keeps well-formed rows away from the format list. Few patterns
    with optional sections, not many patterns, keep the generated code small.
    """
    tidy = f"nullif(trim({text}), '')"
    tries = [f"try_to_timestamp({text})"]
    tries += [f"try_to_timestamp({tidy}, {literal(pattern)})" for pattern in formats]
    # 'T12:30' and '12:30:00' would be read as today at that time; no date ends that early
    timed = f"instr(trim({text}), ':') BETWEEN 1 AND 4"
    return f"CASE WHEN NOT ({timed}) THEN coalesce({', '.join(tries)}) END"


def moment(as_of: str | datetime | Column | None = None) -> Column:
    """The reference instant; the query's own start time unless pinned."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def iso_text(at: Column) -> Column:
    """ISO-8601 text with offset."""
    return F.date_format(at, ISO_FORMAT)

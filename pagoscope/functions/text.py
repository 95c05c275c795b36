"""Text helpers.

The helpers that rules are made of take and return SQL expression text, ready
for ``where``, ``selectExpr`` or ``F.expr``: one text is parsed in one step,
where the same expression from Column calls costs a round trip per operator.
Display helpers take and return Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Edge white space (Unicode, plus the four information
# separators) and the e-mail shape.
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
ONLY_SPACE = r"(?U)^[\s\x1c-\x1f]*$"
EMAIL_SHAPE = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def literal(value) -> str:
    """A Python value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def literals(values) -> str:
    return ", ".join(map(literal, values))


def _starts_visible(text: str) -> str:
    """First character is visible ASCII: two byte comparisons, no regex."""
    return f"({text} >= '!' AND {text} < '\x7f')"


def strip(text: str) -> str:
    """B2: remove Unicode white space at both ends.

    Nearly all values start and end with visible ASCII and need no work; only
    the others pay for the regular expression.
    """
    tidy = f"{_starts_visible(text)} AND {_starts_visible(f'substring({text}, -1, 1)')}"
    edges = f"regexp_replace({text}, {literal(EDGE_SPACE)}, '')"
    return f"CASE WHEN {tidy} THEN {text} ELSE {edges} END"


def upper_strip(text: str) -> str:
    """Strip and upper-case."""
    return f"upper({strip(text)})"


def is_blank(text: str) -> str:
    """B1: null, empty, or nothing but white space; never NULL."""
    only_space = f"rlike({text}, {literal(ONLY_SPACE)})"
    return f"({text} IS NULL OR (NOT {_starts_visible(text)} AND {only_space}))"


def is_email(text: str) -> str:
    """The anchored e-mail shape, on a stripped value."""
    marks = " OR ".join(f"contains({text}, {literal(mark)})" for mark in SEPARATORS)
    return f"(rlike({text}, {literal(EMAIL_SHAPE)}) AND NOT ({marks}))"


def member(text: str, values) -> str:
    """Set containment that is false, not NULL, for a null value."""
    return f"coalesce({text} IN ({literals(values)}), false)"


def code_family(text: str) -> str:
    """The code text before its first colon."""
    return f"substring_index({text}, ':', 1)"


def join_codes(*texts: str) -> str:
    """Join code texts with `` | ``; NULL texts (passed rules) vanish."""
    return f"concat_ws(' | ', {', '.join(texts)})" if texts else "''"


def ellipsis(value: Column, width: int = 90) -> Column:
    """Cut to ``width`` characters and mark the cut."""
    return F.when(
        F.length(value) > width, F.concat(F.substring(value, 1, width), F.lit("..."))
    ).otherwise(value)


def has_item(items: Column, item: str) -> Column:
    """Array membership."""
    return F.array_contains(items, item)


def comma_text(items: Column) -> Column:
    """Array to comma-separated text."""
    return F.array_join(items, ", ")

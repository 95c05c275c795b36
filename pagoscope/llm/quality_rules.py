"""Quality rules, line first: rules judge each line, failing lines go, and a document
that loses too much of its text goes with them.

Defined cases: a null text is a text without words; empty texts and texts of fewer than
10 words fail the base rule; equal rows give equal rows; a null ``doc_id`` stays null;
an empty table gives an empty table; other columns are ignored.

Everything is computed inside a row from built-in functions: no shuffle at all, so skewed
sources or groups of copies cost nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagoscope.llm.common import documents

# The rules of a line.
LINE_END = r"[.!?…:;。！？][\"'”’)\]]*\z"
MARKS = "|»›·•"             # of navigation
MIN_OPEN_WORDS = 8          # a line without an end mark passes if it is this long
MAX_SYMBOL_RUNS = 0.3       # runs such as $$$ or !! per word
MAX_SEPARATORS = 0.25       # navigation marks per word
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "click here", "sign up", "log in", "subscribe", "enable javascript", "lorem ipsum",
    "skip to content", "back to top", "share this",
)
BOILERPLATE_WORDS = 12      # longer lines are prose that mentions such a phrase
MIN_KEPT_SHARE = 0.5        # of the non-space characters

_SPACE = r"[\\x20\\x09-\\x0D]"
_SPACES = (" ", "\\t", "\\n", "\\u000B", "\\u000C", "\\r")


def _text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def line_failure(line: str = "l") -> str:
    """SQL text: the rule that ``line`` breaks (punctuation, navigation, boilerplate) or NULL.

    A line without a word breaks none. Words are counted as blanks plus one; the tests that
    search the line come after cheap ones that most lines settle.
    """
    n_words = f"(1 + length({line}) - length(replace({line}, ' ', '')))"
    marks = f"regexp_count({line}, '[{MARKS}]')"
    has_mark = " or ".join(f"contains({line}, '{m}')" for m in MARKS)
    boilerplate = " or ".join(f"contains(lower({line}), {_text(p)})" for p in BOILERPLATE)
    return f"""case
        when not {line} rlike '[^\\\\x20\\\\x09-\\\\x0D]' then null
        when ({has_mark}) and {marks} >= 2 and {marks} > {MAX_SEPARATORS} * {n_words}
        then 'navigation'
        when regexp_count({line}, '[#*$%&|<>!]{{2,}}') > {MAX_SYMBOL_RUNS} * {n_words}
        then 'punctuation'
        when not right(rtrim({line}), 4) rlike {_text(LINE_END)} and {n_words} < {MIN_OPEN_WORDS}
        then 'punctuation'
        when {n_words} <= {BOILERPLATE_WORDS} and ({boilerplate}) then 'boilerplate'
    end"""


def _without(text: str, characters) -> str:
    for c in characters:
        text = f"replace({text}, '{c}', '')"
    return text


def clean_lines(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, the lines that stay and the verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, lines_removed (by rule: map), kept_share, clean_text, kept.
    """
    rows = documents(docs).selectExpr("doc_id", "coalesce(text, '') as text")
    words = rows.selectExpr(
        "doc_id", "text",
        f"filter(split(text, '{_SPACE}+'), w -> w <> '') as words",
        "split(text, '\\n', -1) as lines",
    )
    windows = words.selectExpr(
        "doc_id", "text", "lines", "size(words) as n_words",
        "length(array_join(words, '')) as word_chars",
        "transform(words, w -> xxhash64(w)) as hashes",
        f"transform(lines, l -> {line_failure()}) as failures",
        "filter(lines, l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') as full_lines",
    )
    # hashes of 2, of 4, and of 5 words in a row, each from the one before
    for wide, left, shift, right in (
        ("pairs", "hashes", 1, "hashes"), ("fours", "pairs", 2, "pairs"), ("windows", "fours", 4, "hashes"),
    ):
        windows = windows.withColumn(wide, F.expr(
            f"case when size({right}) > {shift} then zip_with(slice({left}, 1, size({right}) - {shift}), "
            f"slice({right}, {shift + 1}, size({right}) - {shift}), (a, b) -> xxhash64(a, b)) else array() end"
        ))
    # windows that occur again in the text, by their places; most texts have none
    ordered = windows.selectExpr(
        "*",
        "case when size(array_distinct(windows)) < size(windows) then "
        "sort_array(transform(windows, (h, i) -> struct(h, i))) else array() end as ordered",
        "filter(lines, (l, i) -> get(failures, i) is null) as stay",
    )
    places = ordered.selectExpr(
        "*",
        "sort_array(transform(filter(ordered, (x, k) -> get(ordered, k - 1).h = x.h "
        "or get(ordered, k + 1).h = x.h), x -> x.i)) as places",
        "array_join(stay, '\\n') as clean_text",
    )
    counted = places.selectExpr(
        "doc_id", "text", "failures", "clean_text", "word_chars", "size(lines) as n_lines",
        "n_words",
        f"length(text) - length({_without('text', '#*$%&|<>')}) as n_symbols",
        "size(full_lines) - size(array_distinct(full_lines)) as n_dup_lines",
        "coalesce(aggregate(transform(places, (p, k) -> least(5, coalesce(get(places, k + 1) - p, 5))), "
        "0, (a, x) -> a + x), 0) as n_repeat_words",
        f"case when word_chars = 0 then 0D when size(stay) = size(lines) then 1D else "
        f"length({_without('clean_text', _SPACES)}) / cast(word_chars as double) end as kept_share",
    )
    judged = counted.selectExpr(
        "*",
        "n_words < 10 or 100L * n_repeat_words > 20L * n_words as base_failed",
        "map_from_arrays(array('punctuation', 'navigation', 'boilerplate'), "
        "transform(array('punctuation', 'navigation', 'boilerplate'), "
        "r -> size(filter(failures, f -> f = r)))) as lines_removed",
    )
    return judged.selectExpr(
        "doc_id", "cast(n_words as long) as n_words", "cast(word_chars as long) as word_chars",
        "cast(n_symbols as long) as n_symbols", "cast(n_dup_lines as long) as n_dup_lines",
        "cast(n_repeat_words as long) as n_repeat_words", "base_failed", "n_lines",
        "lines_removed", "kept_share", "clean_text",
        f"not base_failed and kept_share >= {MIN_KEPT_SHARE} as kept",
    )

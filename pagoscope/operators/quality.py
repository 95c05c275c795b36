"""Quality operators (D1-D9) over the row rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagoscope import fixed_values as fv
from pagoscope.functions import (
    clamp, code_family, half_even_int, join_codes, literal, moment, percent, ratio,
)
from pagoscope.operators.quality_rules import (
    CRITICAL, RULES, WARNING, Rule, with_helpers,
)
from pagoscope.sources.layout import ERRORS_COLUMN, ROW_ID, keyed

Rules = Sequence[Rule]


def with_codes(payments: DataFrame, rules: Rules = RULES, as_of=None) -> DataFrame:
    """Payments, the parsed helpers, one code column per rule, and two flags."""
    coded = with_helpers(payments, moment(as_of)).withColumns(
        {r.column: r.expression() for r in rules}
    )
    return coded.withColumns(
        {
            "is_error": F.expr(_any_code(rules, CRITICAL)),
            "is_warning": F.expr(_any_code(rules, WARNING)),
        }
    )


def _any_code(rules: Rules, level: str) -> str:
    codes = [r.column for r in rules if r.level == level]
    return f"coalesce({', '.join(codes)}) IS NOT NULL" if codes else "false"


def _texts(rules: Rules, level: str, mark: str = "") -> list[str]:
    # concat of a NULL code is NULL, which concat_ws then skips
    return [f"concat('{mark}', {r.column})" for r in rules if r.level == level]


def evaluate(payments: DataFrame, rules: Rules = RULES, as_of=None) -> DataFrame:
    """Payments with ``critical``, ``warning``, ``is_error`` and ``dq_errors``."""
    coded = with_codes(payments, rules, as_of)
    marked = join_codes(*_texts(rules, CRITICAL, "[C]"), *_texts(rules, WARNING, "[W]"))
    return coded.select(
        *payments.columns,
        F.expr(join_codes(*_texts(rules, CRITICAL))).alias("critical"),
        F.expr(join_codes(*_texts(rules, WARNING))).alias("warning"),
        "is_error",
        F.when(F.col("is_error"), F.expr(marked)).alias(ERRORS_COLUMN),
    )


_EVALUATION = ("critical", "warning", "is_error", ERRORS_COLUMN)


def clean_zone(evaluated: DataFrame) -> DataFrame:
    """Rows without a critical code, in the original layout."""
    return evaluated.where(~F.col("is_error")).drop(*_EVALUATION)


def errors_zone(evaluated: DataFrame) -> DataFrame:
    """D3: rows with a critical code, plus the text of all their codes."""
    kept = [c for c in _EVALUATION if c != ERRORS_COLUMN]
    return evaluated.where(F.col("is_error")).drop(*kept)


def rule_failures(payments: DataFrame, rule: Rule, as_of=None) -> DataFrame:
    """Rows that break one rule: ``row_id`` (NULL where the payments have none),
    ``level``, ``code``."""
    return (
        with_codes(keyed(payments), (rule,), as_of)
        .select(ROW_ID, F.lit(rule.level).alias("level"), F.col(rule.column).alias("code"))
        .where(F.col("code").isNotNull())
    )


# --------------------------------------------------------------------------
# Counts. One pass over the payments serves D4, D5, D7 and D9: fixed code
# families are conditional counts, and open-ended families are grouping keys, so
# the shuffle carries a row per task and combination of them. Codes outside the
# declared families of a rule make up one more key, which is empty as a rule.
# --------------------------------------------------------------------------
def _fixed_families(rules: Rules) -> list[tuple[str, str]]:
    return [(r.column, family) for r in rules for family in r.families or ()]


def _open_columns(rules: Rules) -> list[str]:
    return [r.column for r in rules if r.families is None]


def _of_family(column: str, family: str) -> str:
    return f"({column} = {literal(family)} OR startswith({column}, {literal(family + ':')}))"


STRAYS = "_strays"  # array of the families outside the declared ones


def _stray_families(rules: Rules) -> list[str]:
    texts = []
    for rule in rules:
        if rule.families is not None and not rule.closed:
            known = " OR ".join(_of_family(rule.column, f) for f in rule.families) or "false"
            texts.append(
                f"CASE WHEN {rule.column} IS NOT NULL AND NOT ({known})"
                f" THEN {code_family(rule.column)} END"
            )
    return texts


def count_measures(rules: Rules) -> dict[str, str]:
    """Conditional counts of the quality pass: name -> SQL condition."""
    measures = {"total_records": "true", "error_records": "is_error",
                "warning_records": "is_warning"}
    for rule in rules:
        families = rule.families or ()
        for family in families:
            hit = f"{rule.column} IS NOT NULL"
            if len(families) > 1 or not rule.closed:
                hit = _of_family(rule.column, family)
            measures[f"n_{family}"] = hit
    return measures


def counted(
    coded: DataFrame, rules: Rules, group_by: Sequence[str], more: dict[str, str] | None = None
) -> DataFrame:
    """The single pass: one row per group and open code family."""
    keys = [F.expr(code_family(c)).alias(c) for c in _open_columns(rules)]
    if strays := _stray_families(rules):
        keys.append(F.expr(f"array_compact(array({', '.join(strays)}))").alias(STRAYS))
    conditions = {**count_measures(rules), **(more or {})}
    return coded.groupBy(*group_by, *keys).agg(
        *[F.expr(f"count_if({when}) AS `{name}`") for name, when in conditions.items()]
    )


def _long_counts(counts: DataFrame, rules: Rules, group_by: Sequence[str]) -> DataFrame:
    pairs = [f"{literal(family)}, `n_{family}`" for _, family in _fixed_families(rules)]
    pairs += [f"{c}, total_records" for c in _open_columns(rules)]
    unpivot = f"stack({len(pairs)}, {', '.join(pairs)}) AS (rule_name, n)"
    if pairs:
        rows = counts.selectExpr(*group_by, unpivot)
    else:
        rows = counts.selectExpr(*group_by, "CAST(NULL AS STRING) AS rule_name", "total_records AS n")
    if _stray_families(rules):
        rows = rows.unionByName(
            counts.selectExpr(*group_by, f"explode({STRAYS}) AS rule_name", "total_records AS n")
        )
    return (
        rows.where("rule_name IS NOT NULL AND n > 0")
        .groupBy(*group_by, "rule_name")
        .agg(F.sum("n").alias("failed_records"))
    )


def failures_by_code(
    payments: DataFrame, group_by: Sequence[str] = (), rules: Rules = RULES, as_of=None
) -> DataFrame:
    """Broken rows per code family."""
    counts = counted(with_codes(payments, rules, as_of), rules, group_by)
    return _long_counts(counts, rules, group_by)


def rule_detail(
    payments: DataFrame,
    group_by: Sequence[str] = (),
    rules: Rules = RULES,
    as_of=None,
    target_table: str = "payments",
) -> DataFrame:
    """Families with hits, most frequent first, ties by name."""
    rows = failures_by_code(payments, group_by, rules, as_of)
    return detail_of(rows, group_by, target_table)


def failures_of(counts: DataFrame, group_by: Sequence[str] = (), rules: Rules = RULES) -> DataFrame:
    """D4 from written counts of the main pass."""
    return _long_counts(counts, rules, group_by)


def detail_of(
    failures: DataFrame, group_by: Sequence[str] = (), target_table: str = "payments"
) -> DataFrame:
    """D6 from the rows of D4."""
    high = F.col("rule_name").isin(*fv.HIGH_SEVERITY_CODES)
    shown = F.when(high, F.lit(fv.DETAIL_HIGH[1])).otherwise(F.lit(fv.DETAIL_OTHER[1]))
    return (
        failures.select(
            *group_by,
            "rule_name",
            F.lit(target_table).alias("target_table"),
            "failed_records",
            F.when(high, F.lit(fv.DETAIL_HIGH[0])).otherwise(F.lit(fv.DETAIL_OTHER[0])).alias("severity"),
            F.lit(fv.DETAIL_STATUS).alias("status"),
            F.concat(F.col("failed_records").cast("string"), F.lit(fv.DETAIL_COMMENT), shown)
            .alias("comments"),
        )
        .orderBy(*group_by, F.desc("failed_records"), "rule_name")
    )


def rolled_up(
    counts: DataFrame, rules: Rules, group_by: Sequence[str], more: Sequence[str] = ()
) -> DataFrame:
    """Fold the open families of :func:`counted` into one row per group."""
    fixed = [f"n_{family}" for _, family in _fixed_families(rules)]
    opens = _open_columns(rules)
    sums = ["total_records", "error_records", "warning_records", *fixed, *more]
    folds = [f"coalesce(sum(`{name}`), 0) AS `{name}`" for name in sums]
    folds += [f"count(DISTINCT {c}) AS families{c}" for c in opens]
    folds += [
        f"coalesce(sum(CASE WHEN {c} IS NOT NULL THEN total_records END), 0) AS issues{c}"
        for c in opens
    ]
    strays = bool(_stray_families(rules))
    if strays:
        folds.append(f"size(array_distinct(flatten(collect_set({STRAYS})))) AS families{STRAYS}")
        folds.append(f"coalesce(sum(size({STRAYS}) * total_records), 0) AS issues{STRAYS}")
        opens = [*opens, STRAYS]
    failed = [f"CAST(`{n}` > 0 AS BIGINT)" for n in fixed] + [f"families{c}" for c in opens]
    issues = [f"`{n}`" for n in fixed] + [f"issues{c}" for c in opens]
    return counts.groupBy(*group_by).agg(*map(F.expr, folds)).selectExpr(
        *group_by,
        "total_records",
        f"CAST({len(rules)} AS BIGINT) AS total_rules",
        f"{' + '.join(failed) or '0L'} AS failed_rules",
        f"{' + '.join(issues) or '0L'} AS total_issues",
        "total_records - error_records AS clean_records",
        "error_records",
        "warning_records",
        *[f"`{name}`" for name in more],
    )


SUMMARY_COLUMNS = (
    "total_records", "total_rules", "failed_rules", "total_issues", "clean_records",
    "error_records", "warning_records",
)


def summary(
    payments: DataFrame, group_by: Sequence[str] = (), rules: Rules = RULES, as_of=None
) -> DataFrame:
    """The quality snapshot, one row (or one per group)."""
    counts = counted(with_codes(payments, rules, as_of), rules, group_by)
    return rolled_up(counts, rules, group_by).select(*group_by, *SUMMARY_COLUMNS)


def data_quality_score() -> Column:
    """Clean percentage minus 0.3 per failed family, rounded, 0..100."""
    share = f"coalesce({ratio('clean_records', 'total_records')}, 1D)"
    return F.expr(clamp(half_even_int(f"{share} * 100 - failed_rules * 0.3D"), 0, 100))


def readiness(summary_rows: DataFrame, posture: dict[str, int | Column] | None = None) -> DataFrame:
    """Readiness scores on summary rows; all other columns are kept.

    ``posture`` overrides the scores that payments cannot tell, each by a number
    or by a Column (for instance a column of a joined posture table).
    """
    given = {**fv.POSTURE, **(posture or {})}
    as_int = {
        name: (value if isinstance(value, Column) else F.lit(value)).cast("int")
        for name, value in given.items()
    }
    scored = summary_rows.withColumns({"data_quality_score": data_quality_score(), **as_int})
    general = (
        "(data_quality_score + cloud_readiness_score + (100 - security_risk_score)"
        " + (100 - compliance_risk_score)) / 4"
    )
    return scored.withColumn("readiness_general", F.expr(half_even_int(general)))


READINESS_COLUMNS = (
    "data_quality_score", "cloud_readiness_score", "security_risk_score",
    "compliance_risk_score", "migration_risk_score", "readiness_general",
)


def readiness_texts(scored: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """One row per readiness dimension with its text."""
    return texts_by_threshold(scored, fv.READINESS_TEXTS, group_by)


def texts_by_threshold(scored: DataFrame, table, group_by: Sequence[str]) -> DataFrame:
    """Unpivot scores to (dimension, score, interpretation) by a threshold table."""
    rows = []
    for dimension, column, comparison, threshold, text, otherwise in table:
        shown = literal(text)
        if column is not None:
            shown = (
                f"CASE WHEN {column} {comparison} {threshold} THEN {literal(text)}"
                f" ELSE {literal(otherwise)} END"
            )
        rows.append(f"{literal(dimension)}, CAST({column or 'NULL'} AS INT), {shown}")
    return scored.selectExpr(
        *group_by, f"stack({len(rows)}, {', '.join(rows)}) AS (dimension, score, interpretation)"
    )


def holds(value: Column, comparison: str, threshold: int) -> Column:
    return {
        "<": value < threshold,
        ">": value > threshold,
        ">=": value >= threshold,
    }[comparison]


def zone_percentages(summary_rows: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Share of each zone to one digit."""
    return summary_rows.selectExpr(
        *group_by,
        "total_records",
        f"{percent('clean_records', 'total_records')} AS pct_clean",
        f"{percent('error_records', 'total_records')} AS pct_error",
    )

"""Run totals: all that scores, advice and reports need, in three scans.

One conditional aggregate covers the quality counts and every row- and
table-level finding; each group rule adds one key count over its own two
columns. No finding is materialised, and what is shuffled is one row per task
and key. ``group_by`` gives one row per system, each judged as its own table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pagoscope.operators import findings as fd
from pagoscope.operators import quality
from pagoscope.operators.quality_rules import RULES, Rule


def found(rule: str) -> str:
    """Column with the number of findings of a rule."""
    return f"found_{rule}"


def weight(rule: str) -> str:
    """Column with the affected records of a rule."""
    return f"weight_{rule}"


def rule_names(rules: Sequence[fd.Finding]) -> list[str]:
    return list(dict.fromkeys(rule.rule for rule in rules))


def hits(finding_rules: Sequence[fd.Finding]) -> dict[str, str]:
    """Counts of the main pass besides the quality ones: name -> SQL condition."""
    hits = {f"row_{r.rule}": r.when for r in fd.of_kind(finding_rules, fd.RowFinding)}
    tables = fd.of_kind(finding_rules, fd.TableFinding)
    return hits | {fd.table_count(r): r.when for r in tables}


def main_counts(
    payments: DataFrame, group_by: Sequence[str] = (), rules: Sequence[Rule] = RULES,
    finding_rules: Sequence[fd.Finding] = fd.FINDINGS, as_of=None,
) -> DataFrame:
    """The main pass: conditional counts of quality codes and of row and table findings,
    a row per group and open code family. D4-D7 and the totals are all folds of it."""
    coded = quality.with_codes(payments, rules, as_of)
    return quality.counted(coded, rules, group_by, hits(finding_rules))


def folded_counts(counts, group_by=(), rules=RULES, finding_rules=fd.FINDINGS) -> DataFrame:
    """:func:`main_counts` as one row per group."""
    return quality.rolled_up(counts, rules, group_by, list(hits(finding_rules)))


def _main_totals(counts, group_by, rules, finding_rules) -> DataFrame:
    row_rules = fd.of_kind(finding_rules, fd.RowFinding)
    table_rules = fd.of_kind(finding_rules, fd.TableFinding)
    folded = folded_counts(counts, group_by, rules, finding_rules)
    measures: dict[str, list[tuple[str, str]]] = {}
    for rule in row_rules:
        n = f"row_{rule.rule}"
        measures.setdefault(rule.rule, []).append((n, n))
    for rule in table_rules:
        n = fd.table_count(rule)
        measures.setdefault(rule.rule, []).append((f"CAST({n} > 0 AS BIGINT)", n))
    for rule in fd.of_kind(finding_rules, fd.SystemFinding):
        measures.setdefault(rule.rule, []).append(("1L", "1L"))
    return folded.selectExpr(
        *group_by,
        *quality.SUMMARY_COLUMNS,
        *[f"{' + '.join(n for n, _ in pairs)} AS {found(name)}"
          for name, pairs in measures.items()],
        *[f"{' + '.join(w for _, w in pairs)} AS {weight(name)}"
          for name, pairs in measures.items()],
    )


def _key_pass(payments, rule: fd.GroupFinding, group_by) -> DataFrame:
    return _found(fd.group_counts(fd.parsed(payments), rule, group_by), rule, group_by)


def _found(rows: DataFrame, rule: fd.Finding, group_by) -> DataFrame:
    return rows.groupBy(*group_by).agg(
        F.expr(f"count(1) AS {found(rule.rule)}"),
        F.expr(f"sum(coalesce(affected_records, 1)) AS {weight(rule.rule)}"),
    )


def run_totals(
    payments: DataFrame,
    group_by: Sequence[str] = (),
    rules: Sequence[Rule] = RULES,
    finding_rules: Sequence[fd.Finding] = fd.FINDINGS,
    as_of=None,
) -> DataFrame:
    """Quality counts and, per finding rule, ``found_*`` and ``weight_*`` columns.

    The partial results meet in a union and one small aggregate, so groups need
    no join and a NULL system is a group like any other.
    """
    counts = main_counts(payments, group_by, rules, finding_rules, as_of)
    passes = [_main_totals(counts, group_by, rules, finding_rules)]
    passes += [
        _key_pass(payments, r, group_by) for r in fd.of_kind(finding_rules, fd.GroupFinding)
    ]
    passes += [
        _found(r.find(payments, group_by), r, group_by)
        for r in fd.of_kind(finding_rules, fd.CustomFinding)
    ]
    return _together(passes, group_by, finding_rules)


def totals_from(
    counts: DataFrame, groups: DataFrame, group_by: Sequence[str] = (),
    rules: Sequence[Rule] = RULES, finding_rules: Sequence[fd.Finding] = fd.FINDINGS,
) -> DataFrame:
    """The same totals from written :func:`main_counts` and ``findings.group_findings``."""
    passes = [_main_totals(counts, group_by, rules, finding_rules)]
    passes += [
        _found(groups.where(F.col("rule") == r.rule), r, group_by)
        for r in fd.of_kind(finding_rules, fd.GroupFinding)
    ]
    return _together(passes, group_by, finding_rules)


def _together(passes, group_by, finding_rules) -> DataFrame:
    together = reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True), passes
    )
    names = rule_names(finding_rules)
    measures = (
        list(quality.SUMMARY_COLUMNS) + [found(n) for n in names] + [weight(n) for n in names]
    )
    return together.groupBy(*group_by).agg(
        *[F.expr(f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}") for m in measures]
    )


def _added(columns: Sequence[str]) -> str:
    return " + ".join(["0L", *columns])


def total_findings(finding_rules: Sequence[fd.Finding] = fd.FINDINGS) -> str:
    """SQL text: number of findings of a totals row."""
    return _added([found(n) for n in rule_names(finding_rules)])


def area_weight(*areas: str, finding_rules: Sequence[fd.Finding] = fd.FINDINGS) -> str:
    """SQL text: affected records of risk areas of a totals row."""
    rules = [r for r in finding_rules if r.risk_area in areas]
    return _added([weight(n) for n in rule_names(rules)])


def count_where(test, finding_rules: Sequence[fd.Finding] = fd.FINDINGS) -> str:
    """SQL text: findings of a totals row whose rule passes ``test``."""
    return _added([found(n) for n in rule_names([r for r in finding_rules if test(r)])])

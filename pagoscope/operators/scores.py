"""Regulatory scores (F3-F13) as projections on the run totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pagoscope import fixed_values as fv
from pagoscope.functions import (
    clamp, half_even_int, iso_text, literal, moment, percent, ratio,
)
from pagoscope.operators import findings as fd
from pagoscope.operators import totals as tt
from pagoscope.operators.quality import holds, texts_by_threshold

# output column -> risk areas it adds up
AREA_TOTALS = {
    "traceability_issues": ("traceability",),
    "financial_issues": ("financial_integrity",),
    "audit_issues": ("audit", "audit_trail"),
    "encryption_issues": ("encryption",),
    "sanctions_issues": ("sanctions_compliance",),
    "aml_issues": ("aml_compliance",),
    "resilience_issues": ("operational_resilience",),
}
SCORE_COLUMNS = (
    "regulatory_risk_score", "pci_readiness_score", "sox_traceability_score",
    "pii_exposure_score", "encryption_coverage_score", "auditability_score",
    "ofac_sanctions_score", "aml_risk_score", "dora_resilience_score",
)


def risk_areas(rules: Sequence[fd.Finding] = fd.FINDINGS) -> list[str]:
    return list(dict.fromkeys(rule.risk_area for rule in rules))


def area_totals(totals: DataFrame, group_by: Sequence[str] = (), rules=fd.FINDINGS) -> DataFrame:
    """F3 on run totals: (risk_area, affected) for areas that have findings."""
    rows = [
        f"{literal(area)}, {tt.area_weight(area, finding_rules=rules)}"
        for area in risk_areas(rules)
    ]
    return totals.selectExpr(
        *group_by, f"stack({len(rows)}, {', '.join(rows)}) AS (risk_area, affected)"
    ).where("affected > 0")


# score -> the risk totals it reads
SCORE_INPUTS = {
    "pci_readiness_score": ("financial_issues", "encryption_issues", "traceability_issues", "sanctions_issues"),
    "sox_traceability_score": ("traceability_issues", "audit_issues"),
    "pii_exposure_score": ("encryption_issues",),
    "encryption_coverage_score": ("encryption_issues",),
    "auditability_score": ("audit_issues", "traceability_issues"),
    "ofac_sanctions_score": ("sanctions_issues",),
    "aml_risk_score": ("aml_issues",),
    "dora_resilience_score": ("resilience_issues",),
}


def rules_behind(
    columns: Sequence[str], rules: Sequence[fd.Finding] = fd.FINDINGS
) -> tuple[fd.Finding, ...]:
    """The finding rules that the given scores read; run totals of these alone suffice."""
    if set(columns) - set(SCORE_INPUTS):  # the overall risk reads every score
        return tuple(rules)
    areas = {area for c in columns for total in SCORE_INPUTS[c] for area in AREA_TOTALS[total]}
    return tuple(rule for rule in rules if rule.risk_area in areas)


def area_pivot(totals: DataFrame, rules: Sequence[fd.Finding] = fd.FINDINGS) -> DataFrame:
    """one column per risk total; every input column is kept."""
    return totals.selectExpr(
        "*",
        *[f"{tt.area_weight(*areas, finding_rules=rules)} AS {name}"
          for name, areas in AREA_TOTALS.items()],
    )


def _penalty(issues: str, points: int, limit: int) -> str:
    """Rounded points for a share of affected records, 0 for an empty table."""
    share = half_even_int(f"{ratio(issues, 'total_records')} * {points}")
    return f"least({limit}, coalesce({share}, 0))"


def _any(issues: str, points: int, otherwise: int = 0) -> str:
    return f"CASE WHEN {issues} > 0 THEN {points} ELSE {otherwise} END"


def _per_issue(issues: str, points: int) -> str:
    return f"CAST(least(100, {issues} * {points}) AS INT)"


def regulatory_scores(
    totals: DataFrame, rules: Sequence[fd.Finding] = fd.FINDINGS
) -> DataFrame:
    """Nine scores next to the totals."""
    pci = (
        f"100 - {_penalty('financial_issues', 60, 25)}"
        f" - {_any('encryption_issues', 25)}"
        f" - {_penalty('traceability_issues', 30, 10)}"
        f" - {_any('sanctions_issues', 15)}"
    )
    sox = (
        f"100 - {_penalty('traceability_issues', 60, 20)}"
        f" - {_penalty('audit_issues', 40, 15)}"
    )
    audit = (
        f"100 - {_penalty('audit_issues', 50, 25)}"
        f" - {_penalty('traceability_issues', 30, 15)}"
    )
    scored = area_pivot(totals, rules).selectExpr(
        "*",
        f"{clamp(pci, 25, 100)} AS pci_readiness_score",
        f"{clamp(sox, 40, 100)} AS sox_traceability_score",
        f"{_any('encryption_issues', 75, 18)} AS pii_exposure_score",
        f"{_any('encryption_issues', 30, 80)} AS encryption_coverage_score",
        f"{clamp(audit, 35, 100)} AS auditability_score",
        f"{_per_issue('sanctions_issues', 8)} AS ofac_sanctions_score",
        f"{_per_issue('aml_issues', 15)} AS aml_risk_score",
        f"{_any('resilience_issues', 85, 20)} AS dora_resilience_score",
    )
    return scored.selectExpr("*", f"{regulatory_risk()} AS regulatory_risk_score")


def regulatory_risk() -> str:
    """weighted mean of seven scores; the sum keeps the order of its terms."""
    risk = (
        "(1 - pci_readiness_score / 100) * 25"
        " + (1 - sox_traceability_score / 100) * 15"
        " + (pii_exposure_score / 100) * 20"
        " + (1 - encryption_coverage_score / 100) * 15"
        " + (1 - auditability_score / 100) * 10"
        " + (ofac_sanctions_score / 100) * 10"
        " + (aml_risk_score / 100) * 5"
    )
    return clamp(half_even_int(risk), 0, 100)


def run_metadata(
    totals: DataFrame, group_by: Sequence[str] = (), rules: Sequence[fd.Finding] = fd.FINDINGS
) -> DataFrame:
    """F11 on totals with readiness scores: record totals, error share, number of findings, findings by area as text."""
    shown = []
    for area in sorted(risk_areas(rules)):
        n = tt.area_weight(area, finding_rules=rules)
        shown.append(f"CASE WHEN {n} > 0 THEN concat({literal(area + '=')}, {n}) END")
    return totals.selectExpr(
        *group_by,
        "total_records",
        "clean_records",
        "error_records",
        f"{percent('error_records', 'total_records')} AS pct_error",
        f"{tt.total_findings(rules)} AS total_findings",
        f"concat_ws(', ', {', '.join(shown)}) AS findings_by_area",
        "data_quality_score AS dq_score_input",
        "cloud_readiness_score AS cloud_readiness_input",
    )


def findings_by_framework(
    totals: DataFrame, group_by: Sequence[str] = (), rules: Sequence[fd.Finding] = fd.FINDINGS
) -> DataFrame:
    """findings per listed framework, zero rows included.

    A finding counts under each of its frameworks, so the rows add up to more
    than the number of findings. Frameworks outside the list are not shown.
    """
    rows = [
        f"{i}, {literal(name)},"
        f" {tt.count_where(lambda r, name=name: name in r.frameworks, rules)}"
        for i, name in enumerate(fv.FRAMEWORKS, 1)
    ]
    return totals.selectExpr(
        *group_by,
        f"stack({len(rows)}, {', '.join(rows)}) AS (framework_order, framework, findings)",
    )


def score_texts(scored: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """one row per score with its interpretation."""
    return texts_by_threshold(scored, fv.REGULATORY_TEXTS, group_by)


def score_document(
    scored: DataFrame,
    group_by: Sequence[str] = (),
    system: str = "payments",
    as_of=None,
    rules: Sequence[fd.Finding] = fd.FINDINGS,
) -> DataFrame:
    """the score document, one row (one JSON object) per system."""
    texts = F.struct(
        *[
            F.when(holds(F.col(column), comparison, threshold), text).otherwise(otherwise)
            .alias(dimension)
            for dimension, column, comparison, threshold, text, otherwise in fv.REGULATORY_TEXTS
        ]
    )
    areas = F.struct(
        *[
            F.expr(tt.area_weight(area, finding_rules=rules)).alias(area)
            for area in risk_areas(rules)
        ]
    )
    metadata = F.struct(
        "total_records", "clean_records", "error_records",
        F.expr(percent("error_records", "total_records")).alias("pct_error"),
        F.expr(tt.total_findings(rules)).alias("total_findings"),
        areas.alias("findings_by_area"),
        F.col("data_quality_score").alias("dq_score_input"),
        F.col("cloud_readiness_score").alias("cloud_readiness_input"),
    )
    return scored.select(
        *group_by,
        iso_text(moment(as_of)).alias("generated_at"),
        F.lit(system).alias("system"),
        *SCORE_COLUMNS,
        metadata.alias("metadata"),
        texts.alias("interpretation"),
    )


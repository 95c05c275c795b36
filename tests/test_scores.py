"""Golden tables and thresholds of scores and advice."""

import pytest
from pyspark.sql import functions as F

from pagoscope import fixed_values as fv
from pagoscope.operators import advisor, reports, scores
from pagoscope.operators import findings as fd
from pagoscope.operators import totals as tt

# strategy: implementation, contingency, total, cloud/yr, savings/yr, payback,
# ROI 3y, cumulative 3y
COSTS = {
    "rehost": (133000, 20000, 153000, 14400, 297600, 6, 484, 739800),
    "replatform": (394000, 59000, 453000, 10800, 301200, 18, 99, 450600),
    "refactor": (631000, 95000, 726000, 9600, 302400, 29, 25, 181200),
    "rebuild": (1109000, 166000, 1275000, 9000, 303000, 50, -29, -366000),
    "hybrid": (492000, 74000, 566000, 11400, 300600, 23, 59, 335800),
}


def test_cost_table(spark):
    rows = advisor.cost_table(spark).collect()
    assert {
        r.strategy: (
            r.implementation_cost_usd, r.contingency_usd, r.total_investment_usd,
            r.cloud_annual_cost_usd, r.annual_savings_usd, r.payback_months,
            r.roi_3_years_pct, r.cumulative_savings_3y_usd,
        )
        for r in rows
    } == COSTS


# cloud, dq, regulatory risk, findings -> strategy; both sides of each threshold
DECISIONS = [
    (65, 85, 30, 0, "rehost"), (64, 85, 30, 0, "replatform"), (65, 84, 30, 0, "replatform"),
    (65, 85, 31, 0, "replatform"), (45, 70, 55, 99, "replatform"), (44, 70, 55, 80, "refactor"),
    (45, 69, 55, 80, "refactor"), (45, 70, 56, 80, "refactor"), (30, 0, 99, 80, "refactor"),
    (29, 0, 69, 80, "hybrid"), (30, 0, 69, 81, "hybrid"), (30, 0, 70, 81, "rebuild"),
    (30, 0, 69, 149, "hybrid"), (30, 0, 69, 150, "rebuild"),
]


def test_strategy_thresholds(spark):
    frame = spark.createDataFrame(
        DECISIONS,
        "cloud_readiness_score INT, data_quality_score INT, regulatory_risk_score INT,"
        " findings BIGINT, expected STRING",
    )
    rows = advisor.decide(frame).collect()
    assert len(rows) == len(DECISIONS)
    assert [r for r in rows if r.strategy != r.expected] == []
    weeks = {s[0]: s[1] for s in fv.STRATEGIES}
    assert all(r.effort_weeks == weeks[r.strategy] for r in rows)


def score_row(spark, **values):
    given = {**fv.SCORE_DEFAULTS, **values}
    schema = ", ".join(f"{name} INT" for name in given)
    return spark.createDataFrame([tuple(given.values())], schema)


@pytest.mark.parametrize(
    ("risk", "composite", "level"), [(100, 65, "HIGH"), (97, 64, "MEDIUM"), (0, 35, "LOW")]
)
def test_risk_classes(spark, risk, composite, level):
    row = advisor.with_risk_class(score_row(
        spark, regulatory_risk_score=risk, pci_readiness_score=60, sox_traceability_score=60,
        pii_exposure_score=60, encryption_coverage_score=29,
    )).first()
    assert (row.composite_score, row.regulatory_risk_level) == (composite, level)


def test_frameworks_at_risk_and_their_shown_score(spark):
    def at(pci, sox, pii, enc):
        rows = reports.framework_scores(advisor.frameworks_at_risk(score_row(
            spark, pci_readiness_score=pci, sox_traceability_score=sox,
            pii_exposure_score=pii, encryption_coverage_score=enc,
        ))).collect()
        return [(r.framework, r.score) for r in rows]

    assert at(60, 60, 59, 50) == []
    assert at(59, 58, 60, 49) == [("PCI-DSS", 59), ("SOX", 58), ("GDPR", 60), ("Basel III", 49)]
    assert at(0, 60, 59, 50) == [("PCI-DSS", None)]


def totals_row(spark, total, **weights):
    """A totals row with the given weight per rule."""
    names = tt.rule_names(fd.FINDINGS)
    values = {"total_records": total}
    values |= {tt.found(n): int(weights.get(n, 0) > 0) for n in names}
    values |= {tt.weight(n): weights.get(n, 0) for n in names}
    schema = ", ".join(f"{name} BIGINT" for name in values)
    return scores.regulatory_scores(
        spark.createDataFrame([tuple(values.values())], schema)
    ).first()


def test_scores_without_findings_and_at_their_clamps(spark):
    clean = totals_row(spark, 100)
    assert clean.pci_readiness_score == 100 and clean.sox_traceability_score == 100
    assert clean.auditability_score == 100 and clean.ofac_sanctions_score == 0
    assert clean.aml_risk_score == 0 and clean.dora_resilience_score == 20
    assert clean.regulatory_risk_score == 7  # 3.6 + 3.0, rounded
    worst = totals_row(
        spark, 100, MISSING_PAYMENT_ID=100, INVALID_AMOUNT=100, PLAINTEXT_PII_FIELD=1,
        OFAC_SANCTIONED_COUNTRY=13, EXTREME_AMOUNT=7, NULL_TIMESTAMP=100, DORA_NO_AUDIT_LOG=1,
    )
    assert worst.pci_readiness_score == 25 and worst.sox_traceability_score == 65
    assert worst.auditability_score == 60 and worst.ofac_sanctions_score == 100
    assert worst.aml_risk_score == 100 and worst.dora_resilience_score == 85
    middle = totals_row(spark, 1000, MISSING_PAYMENT_ID=50, INVALID_AMOUNT=125, NULL_TIMESTAMP=45,
                        OFAC_SANCTIONED_COUNTRY=3, EXTREME_AMOUNT=2)
    # round(7.5) = 8, round(1.5) = 2, 15: half-even on both
    assert middle.pci_readiness_score == 100 - 8 - 2 - 15
    assert middle.sox_traceability_score == 100 - 3 - 2
    assert middle.auditability_score == 100 - 2 - 2
    assert middle.ofac_sanctions_score == 24 and middle.aml_risk_score == 30


def test_defaults_fill_missing_and_null_scores(spark):
    frame = spark.createDataFrame([(None,)], "pci_readiness_score INT")
    row = advisor.with_defaults(frame).first().asDict()
    assert row == fv.SCORE_DEFAULTS


def test_duration_and_role_cost(spark):
    row = spark.range(1).select(advisor.duration_months(F.lit(20)).alias("m")).first()
    assert row.m == 4.7
    frame = score_row(spark, cloud_readiness_score=30, regulatory_risk_score=70).withColumn(
        "findings", F.lit(200).cast("bigint")
    )
    decided = advisor.decide(frame)
    costs = {r.role: r.cost_usd for r in reports.role_costs(decided).collect()}
    assert costs["Backend Developer"] == 432000  # no listed rate: 36 * 40 * 150 * 2
    assert reports.team_size(decided).first().team_size == 9

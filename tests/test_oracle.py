"""Spark against DuckDB; ``python tests/compare.py DIR`` runs every query."""

import pytest
from compare import connect, difference
from cases import SMALL

from pagoscope.plans.oracle import ORACLE
from pagoscope.plans.queries import QUERIES

CHECKED = (
    "dq_normalized", "dq_display_texts", "dq_evaluation", "dq_errors_zone",
    "dq_failures_by_code_and_system", "dq_rule_detail", "dq_readiness", "dq_custom_rule",
    "comp_findings", "comp_duplicate_rows", "comp_findings_by_framework", "comp_custom_rule",
    "score_run_metadata", "score_texts", "advisor_strategy", "advisor_risk_class",
    "advisor_phases", "report_top_findings", "report_cost_comparison",
    "report_services_by_layer", "report_key_figures", "report_batch_profile",
    "report_sanctions_table", "dq_custom_rule_summary", "io_csv_by_name", "comp_zone_union",
    "score_pii_and_encryption", "report_alerts", "io_csv_round_trip", "io_zone_tables", "io_dq_summary_table",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, duck, name):
    assert difference(QUERIES[name](spark, SMALL), duck, ORACLE[name]) is None


@pytest.mark.parametrize("query, name, value", [
    ("report_batch_profile", "PROFILE_SANCTIONED_COUNTRIES", ("IR",)),
    ("report_services_by_layer", "SERVICES", (("rebuild", 1, "Amazon EC2"),)),
])
def test_a_changed_constant_shows(spark, duck, monkeypatch, query, name, value):
    monkeypatch.setattr(f"pagoscope.fixed_values.{name}", value)
    assert difference(QUERIES[query](spark, SMALL), duck, ORACLE[query]) is not None

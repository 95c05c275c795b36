"""Relations that hold for any payments table."""

from cases import AS_OF
from pyspark.sql import functions as F

from pagoscope.operators import findings as fd, quality, scores
from pagoscope.operators import totals as tt


def test_golden_counts(payments):
    row = quality.readiness(quality.summary(payments, as_of=AS_OF)).first()
    assert (row.total_records, row.error_records, row.warning_records) == (1500, 103, 953)
    assert (row.failed_rules, row.total_issues) == (61, 1385)
    assert (row.data_quality_score, row.readiness_general) == (75, 40)
    scored = scores.regulatory_scores(tt.run_totals(payments, as_of=AS_OF)).first()
    assert (scored.pci_readiness_score, scored.sox_traceability_score) == (52, 97)
    assert (scored.auditability_score, scored.regulatory_risk_score) == (98, 53)


def test_zones_are_disjoint_and_complete(payments):
    evaluated = quality.evaluate(payments, as_of=AS_OF)
    clean, errors = quality.clean_zone(evaluated), quality.errors_zone(evaluated)
    assert clean.columns == payments.columns
    assert errors.columns == [*payments.columns, "dq_errors"]
    assert clean.count() + errors.count() == payments.count()
    assert clean.join(errors, "row_id", "left_semi").count() == 0


def test_code_counts_add_up(payments):
    counted = quality.failures_by_code(payments, as_of=AS_OF).agg(F.sum("failed_records"))
    assert counted.first()[0] == quality.summary(payments, as_of=AS_OF).first().total_issues


def test_totals_agree_with_the_findings_table(payments):
    for group_by in ((), ("source_system",)):
        counted = {
            (*[r[g] for g in group_by], r.rule): (r.n, r.w)
            for r in fd.findings(payments, group_by).groupBy(*group_by, "rule").agg(
                F.count(F.lit(1)).alias("n"),
                F.sum(F.coalesce("affected_records", F.lit(1))).alias("w"),
            ).collect()
        }
        totals = {}
        for r in tt.run_totals(payments, group_by, as_of=AS_OF).collect():
            for name in tt.rule_names(fd.FINDINGS):
                if r[tt.found(name)]:
                    key = (*[r[g] for g in group_by], name)
                    totals[key] = (r[tt.found(name)], r[tt.weight(name)])
        assert totals == counted


def test_user_finding_rule_reaches_totals_and_scores(payments):
    rule = fd.CustomFinding(
        15, "ROUND_AMOUNT", ("AML",), "MEDIUM", "aml_compliance",
        find=lambda p, group_by: p.where("amount LIKE '%000'").selectExpr(
            *group_by, "payment_id AS record", "'monto redondo' AS detail",
            "CAST(NULL AS BIGINT) AS affected_records",
        ),
    )
    expected = payments.where("amount LIKE '%000'").count()
    assert expected > 0
    rules = (*fd.FINDINGS, rule)
    totals = tt.run_totals(payments, finding_rules=rules, as_of=AS_OF)
    assert totals.first()[tt.found("ROUND_AMOUNT")] == expected
    found = fd.findings(payments, rules=rules)
    assert found.where("rule = 'ROUND_AMOUNT'").count() == expected


def test_duplicate_rows_by_brute_force(payments):
    rows = [(r.row_id, r.payment_id) for r in payments.select("row_id", "payment_id").collect()]
    ids = [pid for _, pid in rows if pid is not None]
    expected = sorted(k for k, pid in rows if pid is not None and ids.count(pid) > 1)
    for hot_ids in (0, 1, 1000):  # none, one, or all repeated ids take the broadcast leg
        found = fd.duplicate_rows(payments, hot_ids).select("row_id").collect()
        assert sorted(r.row_id for r in found) == expected


def test_scores_stay_within_their_limits(payments):
    limits = {
        "pci_readiness_score": (25, 100), "sox_traceability_score": (40, 100),
        "auditability_score": (35, 100), "regulatory_risk_score": (0, 100),
        "ofac_sanctions_score": (0, 100), "aml_risk_score": (0, 100),
    }
    rows = scores.regulatory_scores(
        tt.run_totals(payments, ("country_code",), as_of=AS_OF)
    ).collect()
    assert len(rows) > 10
    for row in rows:
        for name, (low, high) in limits.items():
            assert low <= row[name] <= high

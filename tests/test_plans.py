"""What the physical plans must and must not contain."""

import re

import pytest
from cases import AS_OF, SMALL

from pagoscope.operators import bloom, findings as fd, quality
from pagoscope.operators import totals as tt
from pagoscope.plans.oracle import ORACLE
from pagoscope.plans.queries import QUERIES
from pagoscope.sources import sample


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def parquet(spark, tmp_path_factory):
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    path = str(tmp_path_factory.mktemp("plans") / "payments")
    sample.payments(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


def scans(frame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan(frame))


@pytest.mark.parametrize("name", [
    "score_sox_traceability", "score_pii_and_encryption", "score_auditability",
    "score_sanctions_aml_resilience", "report_alerts",
])
def test_scores_count_only_what_they_read(spark, name):
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan(QUERIES[name](spark, SMALL)))
    assert not any("payment_id" in k for k in keys)
    if "sanctions" not in name and name != "report_alerts":
        assert not any("customer_name" in k for k in keys)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_summary_is_one_scan_and_reads_no_unused_column(parquet):
    read = scans(quality.summary(parquet, as_of=AS_OF))
    assert len(read) == 1
    for unused in ("customer_name", "iban", "swift_bic", "raw_reference", "row_id"):
        assert unused not in read[0]


def test_totals_are_three_scans_and_the_key_passes_are_narrow(parquet):
    read = sorted(scans(tt.run_totals(parquet, as_of=AS_OF)), key=len)
    assert len(read) == 3
    assert read[0] == "payment_id:string"
    assert sorted(read[1].split(",")) == ["amount:string", "customer_name:string"]


def test_partial_aggregation_before_every_shuffle(parquet):
    text = plan(tt.run_totals(parquet, ("source_system",), as_of=AS_OF))
    assert "partial_count" in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("build", [
    lambda p: quality.evaluate(p, as_of=AS_OF), lambda p: fd.findings(p),
    lambda p: fd.duplicate_rows(p), lambda p: tt.run_totals(p, as_of=AS_OF),
])
def test_no_python_and_no_cross_join(parquet, build):
    text = plan(build(parquet))
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Window"):
        assert operator not in text


def test_row_findings_share_one_scan(parquet):
    row_rules = tuple(fd.of_kind(fd.FINDINGS, fd.RowFinding))
    assert len(scans(fd.findings(parquet, rules=row_rules))) == 1


def test_filters_reach_the_scan(parquet):
    text = plan(fd.findings(parquet, rules=fd.rules_named("DUPLICATE_PAYMENT_ID")))
    assert "PushedFilters: [IsNotNull(payment_id)]" in text


def test_duplicate_rows_meet_the_filter_before_the_exchange(spark, parquet):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(fd.duplicate_rows(parquet, hot_ids=0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the leg that carries whole payments: join, sort, exchange, anti join, filter, scan
    leg = next(part for part in text.split("SortMergeJoin")[1:] if "raw_reference" in part)
    leg = "\n".join(line for line in leg.splitlines() if "Subquery" not in line or "Filter" in line)
    assert leg.index("Exchange hashpartitioning") < leg.index("Filter ((") < leg.index("FileScan")
    assert "subquery" in leg[leg.index("Filter (("):].splitlines()[0].lower()


def test_the_filter_holds_every_key_and_few_others(spark):
    held = spark.range(5000).selectExpr("concat('PAY-', id) as payment_id")
    all_keys = spark.range(105_000).selectExpr("concat('PAY-', id) as payment_id", "id")
    passed = all_keys.where(bloom.may_hold(bloom.bloom_filter(held, "payment_id"), "payment_id"))
    assert passed.where("id < 5000").count() == 5000
    assert passed.where("id >= 5000").count() < 20
    none = bloom.bloom_filter(held.limit(0), "payment_id")
    assert all_keys.where(bloom.may_hold(none, "payment_id")).isEmpty()

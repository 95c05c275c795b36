"""Round trips, zones, catalog and connector options."""

import json
from pathlib import Path

import pytest
from cases import AS_OF

from pagoscope.operators import findings as fd, quality
from pagoscope.plans import assessment
from pagoscope.sources import catalog, files, jdbc, zones
from pagoscope.sources.layout import (
    NA_TOKENS, PAYMENT_COLUMNS, SOURCE_COLUMNS, conform, payments_schema, rename_source,
)


def test_csv_keeps_quotes_commas_and_spaces(table, tmp_path):
    frame = conform(table({"customer_name": 'A "B", C', "amount": "   ", "status": " x "},
                          {"customer_name": None, "payment_id": "ñ→"}))
    frame = frame.select(*PAYMENT_COLUMNS)
    files.write_csv(frame, f"{tmp_path}/csv")
    back = files.read_csv(frame.sparkSession, f"{tmp_path}/csv")
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))


def test_na_tokens_are_optional(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        ",".join(PAYMENT_COLUMNS) + "\n" + ",".join(["NA"] * len(PAYMENT_COLUMNS)) + "\n"
    )
    plain = files.read_csv(spark, str(tmp_path / "in.csv")).first()
    compatible = files.read_csv(spark, str(tmp_path / "in.csv"), na_tokens=NA_TOKENS).first()
    assert plain.country_code == "NA" and compatible.country_code is None


def test_zones_written_once_with_counts(spark, payments, tmp_path):
    evaluated = quality.evaluate(payments, as_of=AS_OF)
    counts = zones.write_zones(evaluated, f"{tmp_path}/zones").get
    assert counts == {"total_records": 1500, "error_records": 103, "warning_records": 953}
    back = zones.read_zones(spark, f"{tmp_path}/zones")
    assert zones.clean_rows(back).count() == 1397
    assert zones.error_rows(back).where("dq_errors LIKE '[C]%'").count() == 103
    zones.write_zones(evaluated, f"{tmp_path}/zones")  # a second run replaces the first
    assert zones.read_zones(spark, f"{tmp_path}/zones").count() == 1500


def test_catalog_tables(spark, payments, tmp_path):
    files.write_csv(payments, f"{tmp_path}/raw")
    catalog.create_database(spark, "t_zones", f"{tmp_path}/db")
    assert not catalog.table_exists(spark, "t_zones", "payments_raw")
    assert not catalog.table_exists(spark, "t_absent", "payments_raw")
    catalog.create_csv_table(
        spark, "t_zones.payments_raw", catalog.payments_columns(row_id=True), f"{tmp_path}/raw"
    )
    assert catalog.table(spark, "t_zones", "payments_raw").count() == 1500
    catalog.drop_tables(spark, "t_zones")
    catalog.drop_tables(spark, "t_zones")
    assert not catalog.table_exists(spark, "t_zones", "payments_raw")
    assert any(Path(f"{tmp_path}/raw").glob("part-*"))


def test_rename_fills_absent_columns(spark):
    source = spark.createDataFrame([("p", "n", "2024-01-01")],
                                   "payment_id STRING, full_name STRING, created_at STRING")
    row = rename_source(source).first()
    assert list(row.asDict()) == list(SOURCE_COLUMNS)
    assert row.customer_name == "n" and row.updated_at == "2024-01-01" and row.iban is None


def test_jdbc_options():
    plain = jdbc.JdbcSource("jdbc:x", "t", one_connection=True)
    assert "numPartitions" not in plain.options()
    split = jdbc.JdbcSource("jdbc:x", "t", "id", 0, 100, 8).options()
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "8"
    with pytest.raises(ValueError):
        jdbc.JdbcSource("jdbc:x", "t", "id").options()
    with pytest.raises(ValueError):
        jdbc.JdbcSource("jdbc:x", "t").options()


def test_indented_document_is_read(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"a": 1, "b": "ñ"}, indent=2))
    row = files.read_json_document(spark, str(tmp_path / "doc.json"), "a INT, b STRING", True)
    assert row.first().asDict() == {"a": 1, "b": "ñ"}


def test_whole_assessment(spark, payments, tmp_path):
    at = assessment.run(spark, payments, f"{tmp_path}/out", as_of=AS_OF)
    found = spark.read.parquet(at["findings"])
    assert found.exceptAll(fd.findings(payments)).isEmpty()
    assert found.count() == fd.findings(payments).count() == 417
    document = spark.read.json(at["scores"]).first()
    assert document.regulatory_risk_score == 53 and document.metadata.total_findings == 417
    assert document.metadata.dq_score_input == 75 and document.metadata.cloud_readiness_input == 38
    snapshot = spark.read.parquet(at["snapshot"])
    assert snapshot.first() == quality.summary(payments, as_of=AS_OF).first()
    detail = spark.read.parquet(at["rule_detail"])
    assert detail.exceptAll(quality.rule_detail(payments, as_of=AS_OF)).isEmpty()
    assert detail.count() == quality.failures_by_code(payments, as_of=AS_OF).count()
    assert spark.read.parquet(at["frameworks"]).count() == 8
    assert spark.read.json(at["readiness"]).first().readiness_general == 40
    assert not spark.read.parquet(at["readiness_texts"]).isEmpty()
    assessment.register(spark, at, "assessment_test")
    assert spark.table("assessment_test.findings").count() == 417
    spark.sql("DROP DATABASE assessment_test CASCADE")
    advice = spark.read.json(at["advice"]).first()
    assert advice.strategy == "rebuild" and advice.migration_complexity_score == 57
    assert advice.composite_score == 50


def test_assessment_reads_the_zones_three_times(spark, payments, tmp_path, monkeypatch):
    read = []
    for module, name in ((assessment.tt, "main_counts"), (assessment.fd, "group_findings"),
                         (assessment.fd, "row_findings")):
        one_pass = getattr(module, name)

        def watched(frame, *args, one_pass=one_pass, name=name, **more):
            result = one_pass(frame, *args, **more)
            plan = result._jdf.queryExecution().optimizedPlan().toString()
            read.append((name, plan.count("Relation [")))
            return result

        monkeypatch.setattr(module, name, watched)
    assessment.run(spark, payments, f"{tmp_path}/out", as_of=AS_OF)
    by_name = dict(read)
    assert by_name["main_counts"] == 1 and by_name["row_findings"] == 1
    # the group rules read one exchange between them, which the plan shows once per rule
    assert by_name["group_findings"] <= 2 and len(read) == 3


def test_csv_is_read_by_name(spark, tmp_path):
    frame = spark.createDataFrame(
        [("10", 'a\n"b"\r\nc', "P1", 7)], "amount STRING, customer_name STRING, payment_id STRING, row_id BIGINT"
    )
    files.write_csv(frame, f"{tmp_path}/csv")
    back = files.read_csv(spark, f"{tmp_path}/csv")
    row = back.first()
    assert (row.amount, row.payment_id, row.row_id) == ("10", "P1", 7)
    assert row.customer_name == 'a\n"b"\r\nc' and row.currency_code is None
    assert back.count() == 1


def test_a_deviating_file_fails_the_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("payment_id,amount\nP1,10\n")
    (tmp_path / "in/b.csv").write_text("amount,payment_id\n10,P1\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path / "in")).collect()


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(ValueError):
        files.scratch_path(spark, "x")


def test_schema_is_all_text():
    assert {f.dataType.simpleString() for f in payments_schema().fields} == {"string"}
    assert len(payments_schema().fields) == 21


def test_rules_run_unchanged_on_a_stream(spark, payments, tmp_path):
    payments.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(payments.schema).parquet(f"{tmp_path}/in")
    running = (
        quality.evaluate(stream, as_of=AS_OF).writeStream.format("memory")
        .queryName("evaluated").outputMode("append").start()
    )
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert spark.table("evaluated").where("is_error").count() == 103

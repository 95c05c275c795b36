"""One row per trap, with codes written by hand."""

from cases import AS_OF
from pyspark.sql import functions as F

from pagoscope.functions import parse_timestamp
from pagoscope.operators import findings as fd, quality, scores
from pagoscope.operators import totals as tt
from pagoscope.operators.quality_rules import RULES, WARNING, Rule, extend

NUMERIC, LIMIT = "[C]amount_no_numerico", "[C]amount_supera_limite"
EMAIL = "[W]email_formato_invalido"
NBSP = " "
CASES = [
    ({"amount": "1_000"}, [NUMERIC]),
    ({"amount": "1.0d"}, [NUMERIC]),
    ({"amount": "0x1p3"}, [NUMERIC]),
    ({"amount": "N/D"}, [NUMERIC]),
    ({"amount": "   "}, ["[C]amount_nulo", NUMERIC, "[W]completado_sin_monto"]),
    ({"amount": None}, ["[C]amount_nulo", "[W]completado_sin_monto"]),
    ({"amount": " 12 "}, []),
    ({"amount": f"{NBSP}12\t"}, []),
    ({"amount": "1e5"}, []),
    ({"amount": ".5"}, []),
    ({"amount": "5."}, []),
    ({"amount": "999999"}, []),
    ({"amount": "Nan"}, []),
    ({"amount": "inf"}, [LIMIT]),
    ({"amount": "999999.01"}, [LIMIT]),
    ({"amount": "-0"}, []),
    ({"amount": "-0.01"}, ["[C]amount_negativo"]),
    ({"status": " completed "}, []),
    ({"status": "on hold"}, ["[W]status_no_reconocido:ON HOLD"]),
    ({"status": "unknown"}, ["[W]status_unknown_legacy"]),
    ({"status": f" {NBSP}"}, ["[W]status_nulo_legacy"]),
    ({"currency_code": None, "country_code": "CO"},
     ["[W]currency_nulo_legacy", "[W]moneda_NAN_no_esperada_para_CO"]),
    ({"currency_code": "  ", "country_code": "CO"}, ["[W]currency_nulo_legacy"]),
    ({"currency_code": "nan", "country_code": "BR"}, ["[W]currency_sin_valor_iso"]),
    ({"currency_code": "EUR"}, ["[W]moneda_EUR_no_esperada_para_US"]),
    ({"currency_code": "EUR", "country_code": "BR"}, []),
    ({"currency_code": "USD", "country_code": "FR"}, []),
    ({"country_code": " ir "}, ["[W]country_desconocido:ir"]),
    ({"country_code": "IR"}, ["[W]country_desconocido:IR"]),
    ({"country_code": None}, ["[W]country_nulo"]),
    ({"customer_email": "a b@c.de"}, [EMAIL]),
    ({"customer_email": f"a{NBSP}b@c.de"}, [EMAIL]),
    ({"customer_email": "a\x1cb@c.de"}, [EMAIL]),
    ({"customer_email": "a@b"}, [EMAIL]),
    ({"customer_email": "@b.co"}, [EMAIL]),
    ({"customer_email": "a@b@c.de"}, [EMAIL]),
    ({"customer_email": "\ta@b.co "}, []),
    ({"customer_email": "ñandú@correo.es"}, []),
    ({"customer_email": ""}, ["[W]customer_email_nulo"]),
    ({"created_at": "not-a-date"}, ["[W]created_at_formato_invalido"]),
    ({"created_at": "2026-01-01 00:00:01", "updated_at": "2026-01-01 00:00:01"},
     ["[W]created_at_futura"]),
    ({"created_at": AS_OF, "updated_at": AS_OF}, []),
    ({"created_at": "20240101"}, []),
    ({"created_at": "01/02/2023"}, []),
    ({"created_at": "13/02/2023"}, []),
    ({"updated_at": "2023-12-31 23:59:59"}, ["[W]updated_at_menor_que_created_at"]),
    ({"updated_at": "  "}, []),
    ({"created_at": None}, ["[W]created_at_nulo"]),
    ({"source_system": "\n"}, ["[W]source_system_nulo"]),
    ({"payment_id": "   "}, ["[C]payment_id_nulo"]),
]


def test_codes_of_every_trap(table):
    rows = quality.evaluate(table(*[change for change, _ in CASES]), as_of=AS_OF).collect()
    for row, (change, expected) in zip(sorted(rows, key=lambda r: r.row_id), CASES):
        got = [f"[C]{c}" for c in row.critical.split(" | ") if c]
        got += [f"[W]{c}" for c in row.warning.split(" | ") if c]
        assert got == expected, change
        critical = any(code.startswith("[C]") for code in expected)
        assert row.is_error == critical
        assert row.dq_errors == (" | ".join(expected) if critical else None)


def rules_of(frame):
    return sorted((r.rule, r.record, r.affected_records) for r in fd.findings(
        frame, rules=fd.rules_named(
            "MISSING_PAYMENT_ID", "INVALID_AMOUNT", "DUPLICATE_PAYMENT_ID",
            "OFAC_SANCTIONED_COUNTRY", "AML_STRUCTURING_PATTERN", "EXTREME_AMOUNT",
        )).collect())


def test_blank_ids_form_a_group_and_null_ids_do_not(table):
    assert rules_of(table({"payment_id": "   "}, {"payment_id": "   "})) == [
        ("DUPLICATE_PAYMENT_ID", "   ", 2),
        ("MISSING_PAYMENT_ID", "1", None), ("MISSING_PAYMENT_ID", "2", None),
    ]
    assert [r[0] for r in rules_of(table({"payment_id": None}, {"payment_id": None}))] == [
        "MISSING_PAYMENT_ID", "MISSING_PAYMENT_ID",
    ]


def test_sanctions_match_the_raw_country_only(table):
    found = rules_of(table(
        {"payment_id": "A", "country_code": "IR"}, {"payment_id": "B", "country_code": " ir "}
    ))
    assert found == [("OFAC_SANCTIONED_COUNTRY", "A", None)]


def test_nan_is_an_invalid_amount_in_compliance_only(table):
    found = rules_of(table({"payment_id": "A", "amount": "Nan"}))
    assert found == [("INVALID_AMOUNT", "A", None)]


def test_structuring_range_is_closed_and_needs_three(table):
    def at(amounts):
        changes = [{"payment_id": str(i), "amount": a} for i, a in enumerate(amounts)]
        return [r for r in rules_of(table(*changes)) if r[0] == "AML_STRUCTURING_PATTERN"]

    assert at(["9000", "9999", "9500"]) == [("AML_STRUCTURING_PATTERN", "A B", 3)]
    assert at(["8999.99", "9999", "9999.01", "9500"]) == []


def test_extreme_amount_text(table):
    rows = fd.findings(
        table({"amount": "1000000"}, {"amount": "1234567.891"}, {"amount": "inf"}),
        rules=fd.rules_named("EXTREME_AMOUNT"),
    ).collect()
    assert sorted(r.detail.split(" — ")[0] for r in rows) == [
        "Monto extremo USD 1,234,567.89", "Monto extremo USD inf",
    ]


def test_empty_table(table):
    empty = table({}).where("false")
    totals = tt.run_totals(empty, as_of=AS_OF)
    row = scores.regulatory_scores(quality.readiness(totals)).first()
    assert row.total_records == 0 and row.failed_rules == 0 and row.total_issues == 0
    assert row.data_quality_score == 100
    assert row.pci_readiness_score == 100 and row.sox_traceability_score == 100
    assert row.auditability_score == 100 and row.pii_exposure_score == 18
    assert row.dora_resilience_score == 85  # the system findings are unconditional
    assert quality.zone_percentages(quality.summary(empty)).first().pct_clean == 0.0
    assert sorted(r.rule for r in fd.findings(empty).collect()) == [
        "DORA_NO_AUDIT_LOG", "NIST_NO_ANOMALY_DETECTION",
    ]


def test_country_currency_pairs_are_families_of_their_own(table):
    frame = table({"currency_code": "EUR"}, {"currency_code": "GBP"}, {"currency_code": "A:B"})
    counts = {r.rule_name: r.failed_records for r in
              quality.failures_by_code(frame, as_of=AS_OF).collect()}
    assert counts == {
        "moneda_EUR_no_esperada_para_US": 1, "moneda_GBP_no_esperada_para_US": 1,
        "moneda_A": 1, "currency_no_habilitada": 1,
    }
    assert quality.summary(frame, as_of=AS_OF).first().failed_rules == 4


def test_severity_list_keeps_two_warning_codes(table):
    rows = quality.rule_detail(
        table({"currency_code": "JPY", "country_code": "BR"}, {"status": "unknown"}),
        as_of=AS_OF,
    ).collect()
    assert {r.rule_name: r.severity for r in rows} == {
        "currency_no_habilitada": "Alta", "status_unknown_legacy": "Media",
    }


def test_user_rules(table):
    rule = Rule("tiny", WARNING, lambda: F.when(F.col("_number") < 1, F.lit("diminuto")),
                ("diminuto",))
    frame = table({"amount": "0.5"}, {"amount": "2"})
    rows = quality.failures_by_code(frame, rules=extend(RULES, rule), as_of=AS_OF).collect()
    assert [(r.rule_name, r.failed_records) for r in rows] == [("diminuto", 1)]
    try:
        extend(RULES, RULES[0])
    except ValueError as error:
        assert "duplicate rule name" in str(error)
    else:
        raise AssertionError("a repeated rule must be refused")


def test_a_time_without_a_date_is_invalid_on_any_day(spark):
    rows = spark.createDataFrame(
        [("T12:30:00",), ("12:30",), (" 9:05:00 ",), ("2024-01-02",), ("2024-01-02T12:30:00",),
         ("2/1/2024 9:05:00",), (None,), ("",)], "t STRING",
    )
    seen = [r[0] is not None for r in rows.selectExpr(f"{parse_timestamp('t')} AS at").collect()]
    assert seen == [False, False, False, True, True, True, False, False]


def test_undeclared_codes_are_counted(table):
    rule = Rule("own", WARNING, "CASE amount WHEN '1' THEN 'a' WHEN '2' THEN 'other:x' END", ("a", "b"))
    payments = table({"amount": "1"}, {"amount": "2"}, {"amount": "2"}, {"amount": "3"})
    rows = quality.failures_by_code(payments, rules=(rule,)).collect()
    assert {(r.rule_name, r.failed_records) for r in rows} == {("a", 1), ("other", 2)}
    total = quality.summary(payments, rules=(rule,)).first()
    assert (total.failed_rules, total.total_issues) == (2, 3)

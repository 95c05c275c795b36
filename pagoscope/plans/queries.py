"""The registered queries: name -> callable(spark, directory of the given tables).

Each runs one or more operators over the whole payments table derived from
``orders`` and ``customer``. The docstring or comment names the operator ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagoscope import fixed_values as fv
from pagoscope.functions import (
    ellipsis, is_blank, is_email, nan_to_null, parse_number, parse_timestamp, strip,
    thousands, upper_strip,
)
from pagoscope.operators import advisor, findings as fd, increments, quality, reports, scores
from pagoscope.operators import totals as tt
from pagoscope.operators.batch_rules import iban_rule
from pagoscope.operators.quality_rules import CRITICAL, RULES, WARNING, Rule, extend
from pagoscope.session import tune
from pagoscope.streaming import zones as streamed
from pagoscope.sources import catalog, clustered, files, sample, versions, zones
from pagoscope.sources.layout import (
    ERRORS_COLUMN, PAYMENT_COLUMNS, ROW_ID, SOURCE_COLUMNS, payments_schema, rename_source,
)

AS_OF = "2026-01-01 00:00:00"
SYSTEM = ("source_system",)
SEGMENT = ("system",)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    """Register a callable that takes (spark, payments)."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, sample.payments(tune(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        return build

    return register


def segmented(payments: DataFrame) -> DataFrame:
    """One system per source and country, so that advice differs between rows."""
    return payments.withColumn(
        "system",
        F.concat_ws(
            "/",
            F.coalesce("source_system", F.lit("-")),
            F.coalesce("country_code", F.lit("-")),
        ),
    )


def scored(payments: DataFrame, group_by=(), columns=scores.SCORE_COLUMNS) -> DataFrame:
    """The scores asked for; findings that none of them reads are not counted."""
    rules = scores.rules_behind(columns)
    return scores.regulatory_scores(
        tt.run_totals(payments, group_by, finding_rules=rules, as_of=AS_OF), rules
    )


def documented(payments: DataFrame) -> DataFrame:
    """All scores, with the readiness scores that the run metadata quotes."""
    return scores.regulatory_scores(quality.readiness(tt.run_totals(payments, as_of=AS_OF)))


def decided(payments: DataFrame) -> DataFrame:
    return advisor.decide(advisor.assemble(segmented(payments), SEGMENT, as_of=AS_OF))


def costed(payments: DataFrame) -> DataFrame:
    return advisor.with_costs(decided(payments))


# ------------------------------------------------------------------ scalar helpers
@query("dq_normalized")
def _(spark, p):
    """Parsed and normalised columns of every payment."""
    return p.select(
        ROW_ID,
        F.expr(is_blank("payment_id")).alias("id_blank"),
        F.expr(strip("status")).alias("status_text"),
        F.expr(upper_strip("currency_code")).alias("currency_key"),
        F.expr(parse_number("amount")).alias("amount_number"),
        F.expr(nan_to_null(parse_number("amount"))).alias("amount_coerced"),
        F.date_format(F.expr(parse_timestamp("created_at")), "yyyy-MM-dd HH:mm:ss")
        .alias("created_time"),
        F.expr(f"coalesce({is_email(strip('customer_email'))}, false)").alias("email_valid"),
    )


@query("dq_display_texts")
def _(spark, p):
    """Thousands format and cut texts of every payment."""
    return p.select(
        ROW_ID,
        thousands(F.expr(parse_number("amount")), 2).alias("amount_text"),
        ellipsis(F.coalesce("customer_email", F.lit("")), 20).alias("email_text"),
    )


# ------------------------------------------------------------------ quality rules
def _register_rule(position: int, rule: Rule) -> None:
    @query(f"dq_rule_{rule.name}")
    def _(spark, p):
        return quality.rule_failures(p, rule, AS_OF)

    QUERIES[f"dq_rule_{rule.name}"].__doc__ = f"C{position}: rows that break the rule."


for _position, _rule in enumerate(RULES, 1):
    _register_rule(_position, _rule)


@query("dq_evaluation")
def _(spark, p):
    """Joined critical and warning codes of every payment."""
    return quality.evaluate(p, as_of=AS_OF).select(ROW_ID, "critical", "warning", "is_error")


@query("dq_clean_zone")
def _(spark, p):
    """Rows without a critical code."""
    return quality.clean_zone(quality.evaluate(p, as_of=AS_OF))


@query("dq_errors_zone")
def _(spark, p):
    """D3: rows with a critical code and their code text."""
    return quality.errors_zone(quality.evaluate(p, as_of=AS_OF))


@query("dq_failures_by_code")
def _(spark, p):
    """Broken rows per code family."""
    return quality.failures_by_code(p, as_of=AS_OF)


@query("dq_failures_by_code_and_system")
def _(spark, p):
    """D4 per source system."""
    return quality.failures_by_code(p, SYSTEM, as_of=AS_OF)


@query("dq_summary")
def _(spark, p):
    """The snapshot."""
    return quality.summary(p, as_of=AS_OF)


@query("dq_summary_by_system")
def _(spark, p):
    """D5 per source system."""
    return quality.summary(p, SYSTEM, as_of=AS_OF)


@query("dq_rule_detail")
def _(spark, p):
    """Families with severity and comment."""
    return quality.rule_detail(p, as_of=AS_OF)


@query("dq_readiness")
def _(spark, p):
    """Readiness scores per source system."""
    rows = quality.readiness(quality.summary(p, SYSTEM, as_of=AS_OF))
    return rows.select(
        *SYSTEM, "data_quality_score", *fv.POSTURE, "readiness_general"
    )


@query("dq_readiness_texts")
def _(spark, p):
    """Readiness interpretation."""
    return quality.readiness_texts(quality.readiness(quality.summary(p, as_of=AS_OF)))


@query("dq_zone_percentages")
def _(spark, p):
    """Zone shares per source system."""
    return quality.zone_percentages(quality.summary(p, SYSTEM, as_of=AS_OF), SYSTEM)


@query("dq_custom_rule")
def _(spark, p):
    """K1: the registry with a user rule (large payments by legacy systems)."""
    legacy = Rule(
        "legacy_large", WARNING,
        "CASE WHEN source_system = 'LEGACY_COBOL' AND _number > 40000"
        " THEN CASE WHEN row_id % 2 = 0 THEN concat('legacy_monto_alto:', _country)"
        "      ELSE 'legacy_sin_familia' END END",
        ("legacy_monto_alto",),
    )
    return quality.failures_by_code(p, rules=extend(RULES, legacy), as_of=AS_OF)


@query("dq_custom_rule_summary")
def _(spark, p):
    """K1: the snapshot counts codes outside the declared families too."""
    stray = Rule(
        "odd_rows", WARNING, "CASE row_id % 1000 WHEN 1 THEN 'odd_a' WHEN 2 THEN 'odd_b:x' END",
        ("odd_a", "odd_unused"),
    )
    return quality.summary(p, rules=(stray,), as_of=AS_OF)


def with_ibans(payments: DataFrame) -> DataFrame:
    """Account numbers from the row ids: most are right, some are missing or broken."""
    own = "lpad(CAST(row_id AS STRING), 18, '0')"
    digits = f"lpad(CAST(98 - CAST(concat({own}, '131400') AS DECIMAL(38, 0)) % 97 AS STRING), 2, '0')"
    return payments.withColumn("iban", F.expr(f"""
        CASE WHEN row_id % 17 = 1 THEN NULL
             WHEN row_id % 19 = 2 THEN '  '
             WHEN row_id % 23 = 3 THEN concat('DE00', {own})
             WHEN row_id % 29 = 4 THEN concat('de', {digits}, ' ', {own})
             WHEN row_id % 31 = 5 THEN 'DE12 345'
             WHEN row_id % 37 = 6 THEN 'GB82WEST12345698765432'
             WHEN row_id % 41 = 7 THEN 'GB82 TEST 1234 5698 7654 32'
             ELSE concat('DE', {digits}, {own}) END"""))


@query("dq_batch_rule")
def _(spark, p):
    """The registry with a rule over Arrow batches, the check digits of account numbers."""
    return quality.failures_by_code(with_ibans(p), rules=extend(RULES, iban_rule()), as_of=AS_OF)


@query("dq_batch_rule_evaluation")
def _(spark, p):
    """A critical batch rule decides about the zone of a row."""
    rules = extend(RULES[:2], iban_rule(CRITICAL))
    return quality.evaluate(with_ibans(p), rules, AS_OF).select(ROW_ID, "is_error", ERRORS_COLUMN)


# ------------------------------------------------------------------ compliance
def shown(found: DataFrame) -> DataFrame:
    """Findings with the frameworks as text."""
    return found.withColumn("framework", F.array_join("framework", ", "))


def _register_finding(name: str, position: int) -> None:
    @query(f"comp_{name.lower()}")
    def _(spark, p):
        return shown(fd.findings(p, rules=fd.rules_named(name)))

    QUERIES[f"comp_{name.lower()}"].__doc__ = f"E{position}: findings of the rule."


for _rule in fd.FINDINGS:
    _register_finding(_rule.rule, _rule.seq)


@query("comp_duplicate_rows")
def _(spark, p):
    """E3 at row level: the payments behind the duplicate groups."""
    return fd.duplicate_rows(p).select(ROW_ID, "payment_id")


@query("comp_zone_union")
def _(spark, p):
    """both zones as one table."""
    path = files.scratch_path(spark, "union")
    zones.write_zones(quality.evaluate(p, as_of=AS_OF), path)  # one evaluation for both zones
    routed = zones.read_zones(spark, path)
    return fd.union_zones(zones.clean_rows(routed), zones.error_rows(routed))


@query("comp_findings")
def _(spark, p):
    """the findings table."""
    return shown(fd.findings(p))


@query("comp_findings_by_system")
def _(spark, p):
    """F2 per source system, counted per rule."""
    return fd.findings(p, SYSTEM).groupBy(*SYSTEM, "rule").agg(
        F.count(F.lit(1)).alias("findings"),
        F.sum(F.coalesce("affected_records", F.lit(1))).cast("bigint").alias("affected"),
    )


@query("comp_risk_areas")
def _(spark, p):
    """F3 on the findings table."""
    return fd.weight_by_area(fd.findings(p))


@query("comp_findings_by_framework")
def _(spark, p):
    """findings per listed framework."""
    return scores.findings_by_framework(tt.run_totals(p, as_of=AS_OF))


@query("comp_framework_findings")
def _(spark, p):
    """The findings under one framework."""
    return shown(fd.of_framework(fd.findings(p), "AML"))


@query("comp_custom_rule")
def _(spark, p):
    """K2: the catalogue with a user rule (accounts that use many currencies)."""

    def many_currencies(payments, group_by):
        return (
            payments.where(F.col("customer_name").isNotNull())
            .groupBy(*group_by, "customer_name")
            .agg(
                F.count_distinct("currency_code").alias("_currencies"),
                F.count(F.lit(1)).alias("affected_records"),
            )
            .where(F.col("_currencies") >= 6)
            .select(
                *group_by, F.col("customer_name").alias("record"),
                F.concat(F.col("_currencies").cast("string"), F.lit(" monedas")).alias("detail"),
                "affected_records",
            )
        )

    rule = fd.CustomFinding(
        15, "MANY_CURRENCIES", ("AML",), "MEDIUM", "aml_compliance", find=many_currencies
    )
    return shown(fd.findings(p, rules=(*fd.rules_named("EXTREME_AMOUNT"), rule)))


# ------------------------------------------------------------------ scores
@query("score_risk_areas")
def _(spark, p):
    """F3 from the run totals, per source system."""
    return scores.area_totals(tt.run_totals(p, SYSTEM, as_of=AS_OF), SYSTEM)


@query("score_area_pivot")
def _(spark, p):
    """seven totals in one row per source system."""
    rows = scores.area_pivot(tt.run_totals(p, SYSTEM, as_of=AS_OF))
    return rows.select(*SYSTEM, *scores.AREA_TOTALS)


def _register_scores(name: str, ids: str, *columns: str) -> None:
    @query(name)
    def _(spark, p):
        return scored(p, SYSTEM, columns).select(*SYSTEM, *columns)

    QUERIES[name].__doc__ = f"{ids} per source system."


_register_scores("score_pci_readiness", "F5", "pci_readiness_score")
_register_scores("score_sox_traceability", "F6", "sox_traceability_score")
_register_scores(
    "score_pii_and_encryption", "F7", "pii_exposure_score", "encryption_coverage_score"
)
_register_scores("score_auditability", "F8", "auditability_score")
_register_scores(
    "score_sanctions_aml_resilience", "F9",
    "ofac_sanctions_score", "aml_risk_score", "dora_resilience_score",
)
_register_scores("score_regulatory_risk", "F10", "regulatory_risk_score")


@query("score_regulatory")
def _(spark, p):
    """All nine scores of the whole table."""
    return scored(p).select(*scores.SCORE_COLUMNS)


@query("score_run_metadata")
def _(spark, p):
    """run metadata."""
    return scores.run_metadata(quality.readiness(tt.run_totals(p, as_of=AS_OF)))


@query("score_texts")
def _(spark, p):
    """score interpretation per source system."""
    return scores.score_texts(scored(p, SYSTEM), SYSTEM)


# ------------------------------------------------------------------ advisor
@query("advisor_score_assembly")
def _(spark, p):
    """G1: assembled scores per segment."""
    return advisor.assemble(segmented(p), SEGMENT, as_of=AS_OF).select(
        *SEGMENT, *fv.SCORE_DEFAULTS, "findings"
    )


@query("advisor_strategy")
def _(spark, p):
    """Complexity and strategy per segment."""
    return decided(p).select(
        *SEGMENT, "migration_complexity_score", "strategy", "effort_weeks", "risk_level"
    )


@query("advisor_costs")
def _(spark, p):
    """Cost model per segment."""
    return costed(p).select(
        *SEGMENT, "strategy", "implementation_cost_usd", "contingency_usd",
        "total_investment_usd", "cloud_monthly_cost_usd", "cloud_annual_cost_usd",
        "onpremises_annual_cost_usd", "annual_savings_usd", "payback_months",
        "roi_3_years_pct", "cumulative_savings_3y_usd",
    )


@query("advisor_risk_class")
def _(spark, p):
    """Composite regulatory risk and class per segment."""
    rows = advisor.with_risk_class(advisor.assemble(segmented(p), SEGMENT, as_of=AS_OF))
    return rows.select(
        *SEGMENT, "composite_score", "regulatory_risk_level", "risk_label", "audit_outcome",
        "fine_range",
    )


@query("advisor_frameworks_at_risk")
def _(spark, p):
    """Frameworks below their threshold per segment."""
    return advisor.frameworks_at_risk(
        advisor.assemble(segmented(p), SEGMENT, as_of=AS_OF), SEGMENT
    )


@query("advisor_complexity_by_dimension")
def _(spark, p):
    """Complexity per dimension and segment."""
    rows = advisor.with_risk_class(advisor.assemble(segmented(p), SEGMENT, as_of=AS_OF))
    return advisor.complexity_by_dimension(rows, SEGMENT)


@query("advisor_alternatives")
def _(spark, p):
    """Rejected strategies per segment."""
    return advisor.alternatives(decided(p), SEGMENT)


@query("advisor_phases")
def _(spark, p):
    """Roadmap phases per segment."""
    return advisor.phases(decided(p), SEGMENT)


@query("advisor_services")
def _(spark, p):
    """Services per segment."""
    return advisor.services(decided(p), SEGMENT)


@query("advisor_team")
def _(spark, p):
    """Team per segment."""
    return advisor.team(decided(p), SEGMENT)


@query("advisor_risks")
def _(spark, p):
    """Project risks per segment."""
    return advisor.risks(decided(p), SEGMENT)


@query("advisor_milestones")
def _(spark, p):
    """Milestones per segment."""
    return advisor.milestones(decided(p), SEGMENT)


@query("advisor_duration")
def _(spark, p):
    """Project months per segment."""
    return decided(p).select(
        *SEGMENT, "effort_weeks",
        advisor.duration_months(F.col("effort_weeks")).alias("duration_months"),
    )


@query("advisor_benefits")
def _(spark, p):
    """Benefit rollup per segment."""
    return advisor.benefit_rollup(costed(p), SEGMENT)


# ------------------------------------------------------------------ reports
@query("report_findings_by_severity")
def _(spark, p):
    """H1 per source system."""
    return reports.findings_by_severity(tt.run_totals(p, SYSTEM, as_of=AS_OF), SYSTEM)


@query("report_frameworks_with_findings")
def _(spark, p):
    """H2 per source system."""
    rows = scores.findings_by_framework(tt.run_totals(p, SYSTEM, as_of=AS_OF), SYSTEM)
    return reports.frameworks_with_findings(rows, SYSTEM)


@query("report_top_findings")
def _(spark, p):
    """H3: the first fifty findings in rule order."""
    return reports.top_findings(fd.findings(p))


@query("report_score_bands_workbook")
def _(spark, p):
    """H4: eleven dimensions per segment."""
    return reports.score_bands(decided(p), fv.WORKBOOK_DIMENSIONS, SEGMENT)


@query("report_score_bands_page")
def _(spark, p):
    """H4: thirteen dimensions per segment."""
    return reports.score_bands(decided(p), fv.PAGE_DIMENSIONS, SEGMENT)


@query("report_payments_by_country")
def _(spark, p):
    """H5: payments with an amount per country."""
    return reports.counts_by(p, "country_code")


@query("report_payments_by_system")
def _(spark, p):
    """H6: payments with an amount per source system."""
    return reports.counts_by(p, "source_system")


@query("report_payments_by_status")
def _(spark, p):
    """H7: payments with an amount per status."""
    return reports.counts_by(p, "status")


@query("report_sanctions_table")
def _(spark, p):
    """H8: amounts by id, country, flag and system, unfiltered as shown."""
    return reports.sanctions_table(p)


@query("report_sanctions_table_filtered")
def _(spark, p):
    """H8 limited to sanctioned countries and currencies."""
    return reports.sanctions_table(p, sanctioned_only=True)


@query("report_role_costs")
def _(spark, p):
    """H9: cost per team role and segment."""
    return reports.role_costs(decided(p), SEGMENT)


@query("report_team_size")
def _(spark, p):
    """People per segment."""
    return reports.team_size(decided(p), SEGMENT)


@query("report_cost_comparison")
def _(spark, p):
    """Cost lines, their sums and the shown totals per segment."""
    return reports.cost_comparison(costed(p), SEGMENT)


@query("report_services_by_layer")
def _(spark, p):
    """Services per layer and segment."""
    return reports.services_by_layer(decided(p), SEGMENT)


@query("report_framework_scores")
def _(spark, p):
    """The shown score of each framework at risk per segment."""
    rows = advisor.assemble(segmented(p), SEGMENT, as_of=AS_OF)
    return reports.framework_scores(advisor.frameworks_at_risk(rows, SEGMENT))


@query("report_alerts")
def _(spark, p):
    """Alert flags per segment."""
    columns = ("ofac_sanctions_score", "aml_risk_score")
    return reports.alerts(scored(segmented(p), SEGMENT, columns), SEGMENT)


@query("report_batch_profile")
def _(spark, p):
    """Batch profile."""
    return reports.batch_profile(p)


@query("report_value_counts")
def _(spark, p):
    """Payments per source system, nulls included."""
    return reports.value_counts(p, "source_system")


@query("report_key_figures")
def _(spark, p):
    """Ten key figures per segment."""
    return reports.key_figures(costed(p), SEGMENT)


# ------------------------------------------------------------------ sources and sinks
@query("io_payments_view")
def _(spark, p):
    """The derived payments table."""
    return p


@query("io_extract_projection")
def _(spark, p):
    """A1: system-of-record columns renamed to the layout."""
    source = p.select(
        ROW_ID, *[F.col(c).alias(s) for c, s in SOURCE_COLUMNS.items() if c != "updated_at"]
    )
    return rename_source(source)


@query("io_csv_round_trip")
def _(spark, p):
    """A3, A2: payments through CSV."""
    path = files.scratch_path(spark, "csv")
    files.write_csv(p.select(*PAYMENT_COLUMNS, F.col(ROW_ID).cast("string")), path)
    back = files.read_csv(spark, path, payments_schema((ROW_ID,)))
    return back.withColumn(ROW_ID, F.col(ROW_ID).cast("bigint"))


@query("io_json_round_trip")
def _(spark, p):
    """The score document through JSON."""
    path = files.scratch_path(spark, "scores")
    document = scores.score_document(documented(p), as_of=AS_OF)
    files.write_json_document(document, path)
    return files.read_json_document(spark, path, document.schema).select(
        "generated_at", "system", *scores.SCORE_COLUMNS,
        F.col("metadata.total_records").alias("total_records"),
        F.col("metadata.total_findings").alias("total_findings"),
        F.col("metadata.findings_by_area.sanctions_compliance").alias("sanctions"),
        F.col("interpretation.aml_risk").alias("aml_text"),
    )


@query("comp_report_documents")
def _(spark, p):
    """findings as JSON lines, counted per rule after reading back."""
    path = files.scratch_path(spark, "findings")
    files.write_json_document(fd.findings(p), path)
    return (
        files.read_json_document(spark, path, fd.FINDING_SCHEMA)
        .groupBy("rule", "severity", F.array_join("framework", ", ").alias("framework"))
        .agg(F.count(F.lit(1)).alias("findings"))
    )


@query("io_zone_routing")
def _(spark, p):
    """Both zones from one write, read back."""
    path = files.scratch_path(spark, "zones")
    zones.write_zones(quality.evaluate(p, as_of=AS_OF), path)
    return zones.read_zones(spark, path).select(ROW_ID, zones.ZONE, ERRORS_COLUMN)


@query("io_zone_tables")
def _(spark, p):
    """External tables over the CSV zones."""
    base = files.scratch_path(spark, "tables")
    files.write_csv(p, f"{base}/raw")
    zones.write_zones(quality.evaluate(p, as_of=AS_OF), f"{base}/zones", "csv")
    paths = {
        "payments_raw": f"{base}/raw",
        "payments_clean": f"{base}/zones/{zones.ZONE}={zones.CLEAN}",
        "payments_errors": f"{base}/zones/{zones.ZONE}={zones.ERRORS}",
    }
    database = catalog.fresh_database(spark, "payments_zones", f"{base}/database")
    catalog.create_zone_tables(spark, database, paths, row_id=True)
    rows = [
        catalog.table(spark, database, table).select(
            F.lit(table).alias("table_name"), ROW_ID, "payment_id", "customer_name", "amount",
            F.lit(None).cast("string").alias(ERRORS_COLUMN) if table == "payments_raw"
            else F.col(ERRORS_COLUMN),
        )
        for table in catalog.ZONE_TABLES
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("io_csv_by_name")
def _(spark, p):
    """A2, A3: a file with other columns in another order, and line breaks inside fields."""
    path = files.scratch_path(spark, "by_name")
    notes = F.concat(F.col("customer_name"), F.lit('\n"first",\r\nsecond; '), F.col("amount"))
    files.write_csv(
        p.select("amount", F.lit("x").alias("unknown_column"), notes.alias("customer_name"),
                 "payment_id", ROW_ID), path,
    )
    return files.read_csv(spark, path).select(
        ROW_ID, "payment_id", "customer_name", "amount", "currency_code", "unknown_column"
    )


def _score_table(spark, rows: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    base = files.scratch_path(spark, table)
    files.write_json_document(rows.select(*columns), f"{base}/documents")
    database = catalog.fresh_database(spark, "payments_scores", f"{base}/database")
    catalog.create_json_table(spark, f"{database}.{table}", columns, f"{base}/documents")
    return catalog.table(spark, database, table)


@query("io_compliance_scores_table")
def _(spark, p):
    """The regulatory scores as an external JSON table."""
    document = scores.score_document(documented(p), as_of=AS_OF)
    return _score_table(spark, document, "compliance_scores", catalog.SCORES_TABLE_COLUMNS)


@query("io_dq_summary_table")
def _(spark, p):
    """The readiness scores as an external JSON table."""
    rows = quality.readiness(quality.summary(p, as_of=AS_OF)).withColumn(
        "generated_at", F.lit(AS_OF)
    )
    return _score_table(spark, rows, "dq_summary", catalog.READINESS_TABLE_COLUMNS)


@query("io_catalog_lifecycle")
def _(spark, p):
    """Existence before, during and after a table's life, with its row count."""
    base = files.scratch_path(spark, "lifecycle")
    table = "payments_raw"
    files.write_csv(p, f"{base}/{table}")
    database = catalog.fresh_database(spark, "payments_lifecycle", f"{base}/database")
    before = catalog.table_exists(spark, database, table)
    catalog.create_csv_table(
        spark, f"{database}.{table}", catalog.payments_columns(row_id=True), f"{base}/{table}"
    )
    during = catalog.table_exists(spark, database, table)
    catalog.drop_tables(spark, database)
    after = catalog.table_exists(spark, database, table)
    # the files of an external table outlive it
    return files.read_csv(spark, f"{base}/{table}").agg(
        F.lit(before).alias("before_create"),
        F.lit(during).alias("after_create"),
        F.lit(after).alias("after_drop"),
        F.count(F.lit(1)).alias("records"),
    )


@query("io_full_refresh")
def _(spark, p):
    """A10: a second run replaces the output of the first."""
    path = files.scratch_path(spark, "refresh")
    files.write_parquet(quality.rule_failures(p, RULES[0], AS_OF), path)
    files.write_parquet(quality.rule_failures(p, RULES[1], AS_OF), path)
    return spark.read.parquet(path)


@query("io_preview")
def _(spark, p):
    """The first three payments by row id."""
    return files.preview(p, ROW_ID)


@query("io_csv_split")
def _(spark, p):
    """A2: the same kind of file, read in byte ranges that may cut a quoted field."""
    path = files.scratch_path(spark, "split")
    name = F.concat(F.lit('line\n\n"'), F.col("customer_name"), F.lit('",\r\n'), F.col("payment_id"))
    files.write_csv(p.select(ROW_ID, name.alias("customer_name"), "amount"), path)
    return files.read_csv(spark, path, split=True).select(ROW_ID, "customer_name", "amount", "status")


@query("io_atomic_refresh")
def _(spark, p):
    """What readers see after a run that broke, and after the next complete one."""
    output = files.scratch_path(spark, "refresh")

    def write(*rules) -> str:
        folder = versions.new_folder(output)
        for rule in rules:
            files.write_parquet(quality.rule_failures(p, rule, AS_OF), f"{folder}/{rule.name}")
        return folder

    names = [r.name for r in RULES[:2]]
    versions.publish(spark, output, write(*RULES[:2]), names)
    broken = write(RULES[0])  # the second output never came
    try:
        versions.publish(spark, output, broken, names)
    except ValueError:
        pass
    seen = versions.current(spark, output)
    after_break = spark.read.parquet(seen.outputs[names[1]]).withColumn("version_number", F.lit(seen.number))
    versions.publish(spark, output, write(*RULES[:2]), names)
    now = versions.current(spark, output)
    return after_break.unionByName(
        versions.read(spark, output, names[0]).withColumn("version_number", F.lit(now.number))
    ).select("version_number", ROW_ID, "code")


def in_batches(spark, p, group_by=()) -> str:
    """The state after three batches, of which one came twice."""
    output = files.scratch_path(spark, "state")
    for batch in (2, 0, 2, 1):
        increments.apply(
            spark, output, f"day-{batch}", p.where(F.col(ROW_ID) % 3 == batch), group_by, AS_OF, buckets=4
        )
    return output


@query("dq_incremental_summary")
def _(spark, p):
    """D5 per source system, merged from batches."""
    return increments.summary(spark, in_batches(spark, p, SYSTEM))


@query("dq_incremental_failures")
def _(spark, p):
    """D4 per source system, merged from batches."""
    return increments.failures(spark, in_batches(spark, p, SYSTEM))


@query("comp_incremental_findings")
def _(spark, p):
    """Group findings from key counts that were merged batch by batch."""
    return shown(increments.group_findings(spark, in_batches(spark, p)))


@query("comp_incremental_risk_areas")
def _(spark, p):
    """F3, merged from batches."""
    return increments.risk_areas(spark, in_batches(spark, p))


@query("io_stream_zones")
def _(spark, p):
    """The payments as a stream of files, routed into the zones in micro-batches."""
    base = files.scratch_path(spark, "stream")
    stream = streamed.replay(p, f"{base}/in")
    run = streamed.route(stream, f"{base}/out", f"{base}/checkpoint", as_of=AS_OF).trigger(availableNow=True).start()
    run.awaitTermination()
    return streamed.read_zones(spark, f"{base}/out").select(ROW_ID, zones.ZONE, ERRORS_COLUMN, "warning")


def clustered_zones(spark, p, heavy_ids: int = 5) -> str:
    """The name of the zones of ``p`` as clustered tables, few ids being spread."""
    base = files.scratch_path(spark, "clustered")
    zones.write_zones(quality.evaluate(p, as_of=AS_OF), f"{base}/zones")
    table = f"{catalog.fresh_database(spark, 'payments_clustered', f'{base}/database')}.payments"
    clustered.write(zones.read_zones(spark, f"{base}/zones"), table, f"{base}/tables", 8, heavy_ids)
    return table


@query("io_clustered_zones")
def _(spark, p):
    """Both zones, read back from the tables clustered by payment id."""
    return clustered.read(spark, clustered_zones(spark, p)).select(
        ROW_ID, "payment_id", zones.ZONE, ERRORS_COLUMN
    )


@query("comp_clustered_duplicate_rows")
def _(spark, p):
    """E3 at row level without an exchange by id."""
    rows = clustered.duplicate_rows(spark, clustered_zones(spark, p))
    return rows.select(ROW_ID, "payment_id", zones.ZONE)


@query("comp_clustered_duplicates")
def _(spark, p):
    """E3 by id, counted within the buckets."""
    return clustered.duplicate_counts(spark, clustered_zones(spark, p))


@query("report_clustered_batch_profile")
def _(spark, p):
    """H15 from the clustered zones."""
    return clustered.batch_profile(spark, clustered_zones(spark, p))


@query("io_zone_statistics")
def _(spark, p):
    """What the catalog knows of a partitioned zone table, beside the rows themselves."""
    base = files.scratch_path(spark, "statistics")
    zones.write_zones(quality.evaluate(p, as_of=AS_OF), f"{base}/zones")
    database = catalog.fresh_database(spark, "payments_statistics", f"{base}/database")
    table = f"{database}.payments"
    columns = catalog.payments_columns(row_id=True, errors=True)
    catalog.create_partitioned_table(spark, table, columns, f"{base}/zones", zones.ZONE)
    catalog.analyze(spark, table, ("payment_id", "amount"), zones.ZONE)
    known = [
        spark.table(table).where(F.col(zones.ZONE) == zone).agg(
            F.lit(zone).alias(zones.ZONE),
            F.lit(catalog.partition_rows(spark, table, zones.ZONE, zone)).cast("bigint").alias("known_records"),
            F.lit(catalog.table_rows(spark, table)).cast("bigint").alias("known_total"),
            F.lit(catalog.null_count(spark, table, "payment_id")).cast("bigint").alias("known_null_ids"),
            F.count(F.lit(1)).alias("records"),
            F.count_if(F.col("payment_id").isNull()).alias("null_ids"),
        )
        for zone in (zones.CLEAN, zones.ERRORS)
    ]
    return known[0].unionByName(known[1])

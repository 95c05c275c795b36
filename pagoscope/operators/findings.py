"""Compliance findings (E1-E14), zone union (F1), findings table (F2), registry (K2).

Four shapes of rule, by what one finding stands for:

* row:    one payment; all row rules share one scan
* group:  one key that repeats; counted with map-side combine, so a key that
          holds a third of the table costs one partial row per task
* table:  one field of the whole table; one aggregate serves them all
* system: unconditional

The findings are a long table, never lists per framework.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pagoscope import fixed_values as fv
from pagoscope.functions import has_item, literal, literals, member
from pagoscope.operators.bloom import bloom_filter, may_hold
from pagoscope.operators.quality_rules import with_helpers
from pagoscope.sources.layout import ROW_ID

FINDING_SCHEMA = (
    "rule_seq INT, rule STRING, framework ARRAY<STRING>, severity STRING, record STRING,"
    " detail STRING, risk_area STRING, affected_records BIGINT"
)
FINDING_COLUMNS = (
    "rule_seq", "rule", "framework", "severity", "record", "detail", "risk_area",
    "affected_records",
)
TABLE_LEVEL, SYSTEM_LEVEL = "dataset-level", "system-level"


@dataclass(frozen=True)
class Finding:
    """What all findings of a rule have in common."""

    seq: int
    rule: str
    frameworks: tuple[str, ...]
    severity: str
    risk_area: str


@dataclass(frozen=True)
class RowFinding(Finding):
    """One finding per payment that satisfies ``when``.

    ``when``, ``record`` and ``detail`` are SQL texts over the payment columns
    and the parsed helpers of the quality rules.
    """

    when: str
    record: str
    detail: str


@dataclass(frozen=True)
class GroupFinding(Finding):
    """One finding per ``key`` with at least ``minimum`` payments that satisfy ``when``."""

    key: str
    when: str
    minimum: int
    detail: str


@dataclass(frozen=True)
class TableFinding(Finding):
    """One finding when any payment satisfies ``when``; ``label`` tells fields apart.

    ``detail`` has a place ``{n}`` for the number of such payments.
    """

    label: str
    when: str
    detail: str


@dataclass(frozen=True)
class SystemFinding(Finding):
    """One unconditional finding."""

    detail: str


@dataclass(frozen=True)
class CustomFinding(Finding):
    """K2: a user rule, ``payments -> record, detail, affected_records`` rows.

    With ``group_by`` the function must keep the grouping columns.
    """

    find: Callable[[DataFrame, Sequence[str]], DataFrame]


PAYMENT = "coalesce(payment_id, 'N/A')"
NUMBER_TEXT = (
    "CASE WHEN _number = double('inf') THEN 'inf' ELSE format_number(_number, 2) END"
)


def _text(template: str, **values: str) -> str:
    """SQL text of a message whose ``{name}`` places are filled by expressions."""
    parts = []
    for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if piece.startswith("{"):
            parts.append(f"CAST({values[piece[1:-1]]} AS STRING)")
        elif piece:
            parts.append(literal(piece))
    return f"concat({', '.join(parts)})"


# The rules, their labels and their message texts
FINDINGS: tuple[Finding, ...] = (
    RowFinding(
        1, "MISSING_PAYMENT_ID", ("SOX", "PCI-DSS"), "CRITICAL", "traceability",
        when="_no_id",
        record=f"coalesce(CAST({ROW_ID} AS STRING), 'N/A')",
        detail=_text("payment_id nulo — transacción no auditable"),
    ),
    RowFinding(
        2, "INVALID_AMOUNT", ("SOX", "PCI-DSS"), "CRITICAL", "financial_integrity",
        when="_number IS NULL OR isnan(_number) OR _number < 0",
        record=PAYMENT,
        detail=_text(
            "amount='{amount}' — integridad financiera comprometida",
            amount="coalesce(amount, 'null')",
        ),
    ),
    GroupFinding(
        3, "DUPLICATE_PAYMENT_ID", ("PCI-DSS", "SOX", "Basel III"), "CRITICAL",
        "financial_integrity",
        key="payment_id",
        when="payment_id IS NOT NULL",
        minimum=2,
        detail=_text(
            "payment_id '{key}' aparece {n} veces — riesgo de doble cargo",
            key="payment_id", n="affected_records",
        ),
    ),
    RowFinding(
        4, "OFAC_SANCTIONED_COUNTRY", ("OFAC", "AML", "PCI-DSS"), "CRITICAL",
        "sanctions_compliance",
        when=member("country_code", fv.SANCTIONED_COUNTRIES),
        record=PAYMENT,
        detail=_text(
            "Transacción con país sancionado '{country}' — violación OFAC",
            country="country_code",
        ),
    ),
    RowFinding(
        5, "OFAC_SANCTIONED_CURRENCY", ("OFAC", "AML"), "CRITICAL", "sanctions_compliance",
        when=member("currency_code", fv.SANCTIONED_CURRENCIES),
        record=PAYMENT,
        detail=_text(
            "Moneda sancionada '{currency}' — violación OFAC", currency="currency_code"
        ),
    ),
    GroupFinding(
        6, "AML_STRUCTURING_PATTERN", ("AML", "FinCEN", "Basel III"), "CRITICAL",
        "aml_compliance",
        key="customer_name",
        when="customer_name IS NOT NULL AND"
        f" _number BETWEEN {fv.STRUCTURING_LOW} AND {fv.STRUCTURING_HIGH}",
        minimum=fv.STRUCTURING_MIN_PAYMENTS,
        detail=_text(
            f"'{{key}}' tiene {{n}} transacciones entre ${fv.STRUCTURING_LOW:,}–"
            f"${fv.STRUCTURING_HIGH:,} — patrón de structuring AML",
            key="customer_name", n="affected_records",
        ),
    ),
    *(
        TableFinding(
            7, "PLAINTEXT_PII_FIELD", ("GDPR", "PCI-DSS", "DORA"), "HIGH", "encryption",
            label=field,
            when=f"NOT {blank}",
            detail=f"Campo '{field}' contiene {{n}} valores PII en texto plano"
            " — cifrado requerido",
        )
        for field, blank in zip(fv.PII_FIELDS, ("_no_name", "_no_email"))
    ),
    RowFinding(
        8, "MISSING_CUSTOMER_IDENTITY", ("GDPR", "PCI-DSS"), "HIGH", "audit",
        when="_no_name AND _no_email",
        record=PAYMENT,
        detail=_text("customer_name y customer_email nulos — cliente no identificable"),
    ),
    *(
        TableFinding(
            9, "NULL_TIMESTAMP", ("SOX", "Basel III", "DORA"), "MEDIUM", "audit_trail",
            label=field,
            when=blank,
            detail=f"'{field}' nulo en {{n}} registros — audit trail incompleto",
        )
        for field, blank in zip(fv.TIMESTAMP_FIELDS, ("_no_created", "_no_updated"))
    ),
    TableFinding(
        10, "MISSING_SOURCE_SYSTEM", ("SOX", "Basel III", "DORA"), "MEDIUM", "audit_trail",
        label="source_system",
        when="_no_source",
        detail="source_system nulo en {n} registros — linaje de datos no trazable",
    ),
    TableFinding(
        11, "INVALID_TRANSACTION_STATUS", ("PCI-DSS", "SOX"), "HIGH", "financial_integrity",
        label="status",
        when=f"NOT {member('_status', fv.STATUSES)}",
        detail="{n} registros con status nulo o no reconocido — integridad del ciclo de vida"
        " comprometida",
    ),
    SystemFinding(
        12, "DORA_NO_AUDIT_LOG", ("DORA", "NIST_CSF"), "HIGH", "operational_resilience",
        detail="Sistema sin audit log operacional — incumplimiento DORA Art. 9 y"
        " NIST CSF DE.AE",
    ),
    SystemFinding(
        13, "NIST_NO_ANOMALY_DETECTION", ("NIST_CSF",), "MEDIUM", "operational_resilience",
        detail="Sin mecanismo de detección de anomalías — NIST CSF DE.CM no implementado",
    ),
    RowFinding(
        14, "EXTREME_AMOUNT", ("AML", "PCI-DSS", "Basel III"), "HIGH", "aml_compliance",
        when=f"_number > {fv.EXTREME_AMOUNT} AND NOT isnan(_number)",
        record=PAYMENT,
        detail=_text(
            "Monto extremo USD {amount} — requiere revisión manual AML", amount=NUMBER_TEXT
        ),
    ),
)


def rules_named(*names: str) -> tuple[Finding, ...]:
    """The rules with the given names, for running a part of the catalogue."""
    return tuple(f for f in FINDINGS if f.rule in names)


def of_kind(rules: Sequence[Finding], kind: type) -> list:
    return [rule for rule in rules if isinstance(rule, kind)]


def parsed(payments: DataFrame) -> DataFrame:
    """Payments with the parsed helpers that the rules read.

    Tables without a row key get a NULL one, so that findings still can be told.
    """
    if ROW_ID not in payments.columns:
        payments = payments.withColumn(ROW_ID, F.lit(None).cast("string"))
    return with_helpers(payments, F.lit(None).cast("timestamp"))


def group_counts(rows: DataFrame, rule: GroupFinding, group_by: Sequence[str]) -> DataFrame:
    """Keys of a group rule with their payment counts, on parsed payments."""
    return (
        rows.where(rule.when)
        .groupBy(*group_by, rule.key)
        .agg(F.count(F.lit(1)).alias("affected_records"))
        .where(F.col("affected_records") >= rule.minimum)
    )


def union_zones(clean: DataFrame, errors: DataFrame) -> DataFrame:
    """both zones as one table; ``dq_errors`` is NULL for clean rows."""
    return clean.unionByName(errors, allowMissingColumns=True)


def _finding(rule: Finding, record: str, detail: str, affected: str) -> str:
    """SQL text of one finding as a struct."""
    return (
        f"named_struct('rule_seq', {rule.seq}, 'rule', {literal(rule.rule)},"
        f" 'framework', array({literals(rule.frameworks)}),"
        f" 'severity', {literal(rule.severity)}, 'record', {record}, 'detail', {detail},"
        f" 'risk_area', {literal(rule.risk_area)},"
        f" 'affected_records', CAST({affected} AS BIGINT))"
    )


def _unnested(rows: DataFrame, finding: str, group_by: Sequence[str]) -> DataFrame:
    return rows.select(*group_by, F.expr(finding).alias("_f")).select(*group_by, "_f.*")


def _row_findings(rows, rules, group_by) -> DataFrame:
    # Only the rule number is unpivoted; texts are built for the rows that stay.
    hits = ", ".join(f"CASE WHEN {r.when} THEN {i} END" for i, r in enumerate(rules))
    found = rows.withColumn("_hit", F.expr(f"explode(array({hits}))")).where(
        "_hit IS NOT NULL"
    )
    cases = " ".join(
        f"WHEN {i} THEN {_finding(r, r.record, r.detail, 'NULL')}" for i, r in enumerate(rules)
    )
    return _unnested(found, f"CASE _hit {cases} END", group_by)


def table_count(rule: TableFinding) -> str:
    """Column with the number of payments behind a table rule."""
    return f"table_{rule.rule}_{rule.label}"


def _table_findings(rows, rules, group_by) -> DataFrame:
    """Table and system rules from one aggregate (one row per group)."""
    counts = rows.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.expr(f"count_if({r.when}) AS `{table_count(r)}`") for r in of_kind(rules, TableFinding)],
    )
    return table_findings(counts, rules, group_by)


def table_findings(counts, rules=FINDINGS, group_by=()) -> DataFrame:
    """Table and system findings of counts that hold a ``table_count`` column per rule."""
    found = [
        _finding(
            r, literal(TABLE_LEVEL), _text(r.detail, n=f"`{table_count(r)}`"), f"`{table_count(r)}`"
        )
        for r in of_kind(rules, TableFinding)
    ] + [
        _finding(r, literal(SYSTEM_LEVEL), literal(r.detail), "NULL")
        for r in of_kind(rules, SystemFinding)
    ]
    return counts.selectExpr(*group_by, f"inline(array({', '.join(found)}))").where(
        "affected_records IS NULL OR affected_records > 0"
    )


def row_findings(payments, group_by=(), rules=FINDINGS) -> DataFrame:
    """The findings of the row rules alone, in one scan."""
    return _row_findings(parsed(payments), of_kind(rules, RowFinding), group_by)


def of_counts(counted: DataFrame, rule: GroupFinding, group_by: Sequence[str] = ()) -> DataFrame:
    """The findings of a group rule from its keys and their ``affected_records``."""
    return _unnested(counted, _finding(rule, rule.key, rule.detail, "affected_records"), group_by)


def group_findings(payments, group_by=(), rules=FINDINGS) -> DataFrame:
    """The findings of all group rules in one scan: a payment is counted under each key
    that it has, so the shuffle carries what the separate scans would."""
    groups = of_kind(rules, GroupFinding)
    keys = ", ".join(
        f"CASE WHEN {r.when} THEN named_struct('_i', {i}, '_key', CAST({r.key} AS STRING)) END"
        for i, r in enumerate(groups)
    )
    counted = (
        parsed(payments).select(*group_by, F.expr(f"explode(array({keys}))").alias("_k"))
        .where("_k IS NOT NULL").select(*group_by, "_k.*")
        .groupBy(*group_by, "_i", "_key").agg(F.count(F.lit(1)).alias("affected_records"))
    )
    parts = []
    for i, rule in enumerate(groups):
        kept = counted.where((F.col("_i") == i) & (F.col("affected_records") >= rule.minimum))
        parts.append(of_counts(kept.withColumnRenamed("_key", rule.key), rule, group_by))
    return reduce(DataFrame.unionByName, parts)


def findings(
    payments: DataFrame,
    group_by: Sequence[str] = (),
    rules: Sequence[Finding] = FINDINGS,
) -> DataFrame:
    """every finding of every rule, as one long table.

    With ``group_by`` each group is judged as a table of its own.
    """
    rows = parsed(payments)
    parts: list[DataFrame] = []
    if row_rules := of_kind(rules, RowFinding):
        parts.append(_row_findings(rows, row_rules, group_by))
    for rule in of_kind(rules, GroupFinding):
        finding = _finding(rule, rule.key, rule.detail, "affected_records")
        parts.append(_unnested(group_counts(rows, rule, group_by), finding, group_by))
    if of_kind(rules, TableFinding) or of_kind(rules, SystemFinding):
        parts.append(_table_findings(rows, rules, group_by))
    for rule in of_kind(rules, CustomFinding):
        finding = _finding(rule, "record", "detail", "affected_records")
        parts.append(_unnested(rule.find(payments, group_by), finding, group_by))
    return reduce(DataFrame.unionByName, parts)


HOT_IDS = 1000  # bounds what is broadcast below


def duplicate_rows(payments: DataFrame, hot_ids: int = HOT_IDS) -> DataFrame:
    """E3 at row level: every payment whose non-null id occurs more than once.

    A very frequent id would pull all its rows into one task of a shuffled join.
    So the ``hot_ids`` most frequent ids, a list of proven size, are broadcast
    and their rows never move; every other id holds less than ``1 / hot_ids`` of
    the table and goes through the shuffled join. Both legs together are exact.
    Before that shuffle a Bloom filter over the repeated ids, of fixed size, drops
    nearly all rows whose id occurs once; the join decides about the others.
    """
    if not 0 <= hot_ids <= HOT_IDS:
        raise ValueError(f"hot_ids must lie between 0 and {HOT_IDS}: the list is broadcast")
    keyed = payments.where(F.col("payment_id").isNotNull())
    counts = keyed.groupBy("payment_id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.where(F.col("_n") > 1)
    hot = F.broadcast(
        repeated.orderBy(F.desc("_n"), "payment_id").limit(hot_ids).select("payment_id")
    )
    cold = repeated.join(hot, "payment_id", "left_anti").select("payment_id")
    on_hot = keyed.join(hot, "payment_id", "left_semi")
    likely = keyed.where(may_hold(bloom_filter(repeated, "payment_id"), "payment_id"))
    on_cold = likely.join(hot, "payment_id", "left_anti").join(cold, "payment_id", "left_semi")
    return on_hot.unionByName(on_cold)


def of_framework(found: DataFrame, framework: str) -> DataFrame:
    """The findings that count under one framework."""
    return found.where(has_item(F.col("framework"), framework))


def weight_by_area(found: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """F3 on a findings table: affected records (1 where not counted) per risk area."""
    weight = F.coalesce(F.col("affected_records"), F.lit(1))
    return found.groupBy(*group_by, "risk_area").agg(
        F.sum(weight).cast("bigint").alias("affected")
    )

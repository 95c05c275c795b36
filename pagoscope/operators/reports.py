"""Reporting aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagoscope import fixed_values as fv
from pagoscope.functions import (
    comma_text, ellipsis, half_even, literal, member, nan_to_null, parse_number, strip,
)
from pagoscope.operators import advisor, dimensions as dim
from pagoscope.operators import findings as fd
from pagoscope.operators import totals as tt


def findings_by_severity(
    totals: DataFrame, group_by: Sequence[str] = (), rules: Sequence[fd.Finding] = fd.FINDINGS
) -> DataFrame:
    """H1: findings per severity in fixed order, only those present."""
    rows = [
        f"{i}, {literal(level)},"
        f" {tt.count_where(lambda r, level=level: r.severity == level, rules)}"
        for i, level in enumerate(fv.SEVERITIES, 1)
    ]
    return totals.selectExpr(
        *group_by,
        f"stack({len(rows)}, {', '.join(rows)}) AS (severity_order, severity, findings)",
    ).where("findings > 0")


def frameworks_with_findings(by_framework: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """H2: how many listed frameworks have findings."""
    return by_framework.groupBy(*group_by).agg(
        F.count_if(F.col("findings") > 0).alias("frameworks_with_findings"),
        F.sum("findings").alias("framework_findings"),
    )


def top_findings(found: DataFrame, limit: int = 50) -> DataFrame:
    """H3: the first findings in rule order, details cut for display."""
    return (
        found.orderBy("rule_seq", "record", "detail")
        .limit(limit)
        .select(
            "rule_seq", "severity", "rule", "record",
            comma_text(F.col("framework")).alias("frameworks"),
            ellipsis(F.col("detail")).alias("detail"),
        )
    )


def score_bands(scored: DataFrame, dimensions, group_by: Sequence[str] = ()) -> DataFrame:
    """H4: each score with its band; scores where more is better are inverted."""
    high, moderate, fine = map(literal, fv.BAND_LABELS)
    rows = []
    for position, (name, column, higher_is_better) in enumerate(dimensions, 1):
        risk = f"100 - {column}" if higher_is_better else column
        band = (
            f"CASE WHEN {risk} >= {fv.BAND_HIGH} THEN {high}"
            f" WHEN {risk} >= {fv.BAND_MODERATE} THEN {moderate} ELSE {fine} END"
        )
        rows.append(f"{position}, {literal(name)}, CAST({column} AS INT), {band}")
    return scored.selectExpr(
        *group_by, f"stack({len(rows)}, {', '.join(rows)}) AS (position, dimension, score, band)"
    )


def counts_by(payments: DataFrame, column: str) -> DataFrame:
    """H5-H7: payments with an amount per value of a column."""
    return payments.groupBy(column).agg(F.count("amount").alias("payments"))


def sanctions_table(payments: DataFrame, sanctioned_only: bool = False) -> DataFrame:
    """H8: amounts per payment id, country, flag and source system.

    The table is not limited to sanctioned payments unless asked for.
    """
    if sanctioned_only:
        payments = payments.where(
            f"{member('country_code', fv.SANCTIONED_COUNTRIES)}"
            f" OR {member('currency_code', fv.SANCTIONED_CURRENCIES)}"
        )
    amount = F.expr(strip("amount")).try_cast("decimal(18,2)")
    return payments.groupBy(
        "payment_id", "country_code", "sanction_flag_expected", "source_system"
    ).agg(F.sum(amount).alias("total_amount"))


def role_costs(decided: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """H9: cost per team role, rounded to thousands; unknown roles take a default rate."""
    rates = dim.team_rates(decided.sparkSession)
    share = F.regexp_replace("dedication", "%", "").cast("int") / F.lit(100)
    rate = F.coalesce(F.col("usd_per_hour"), F.lit(fv.TEAM_RATE_OTHERWISE))
    cost = (
        F.col("effort_weeks") * fv.HOURS_PER_WEEK * share * rate * F.col("headcount")
        / F.lit(1000)
    )
    return (
        decided.select(*group_by, "strategy", "effort_weeks")
        .join(dim.teams(decided.sparkSession), "strategy")
        .join(rates, "role", "left")
        .select(
            *group_by, "strategy", "ord", "role", "dedication", "headcount",
            (half_even(cost) * 1000).cast("bigint").alias("cost_usd"),
        )
    )


def team_size(decided: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """People per system; NULL group values stay a group of their own."""
    return (
        advisor.team(decided, group_by)
        .groupBy(*group_by, "strategy")
        .agg(F.sum("headcount").cast("bigint").alias("team_size"))
    )


def cost_comparison(costed: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Six cost lines, their column sums, and the total line as shown.

    The shown totals come from the cost model and differ from the column sums;
    ``kind`` tells the three apart.
    """
    def bigint(value) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast("bigint")

    lines = []
    for position, name, before, after in fv.COST_LINES:
        cloud = F.col("cloud_annual_cost_usd") if after is None else F.lit(after)
        lines.append(
            F.struct(
                F.lit(position).alias("ord"), F.lit(name).alias("line"),
                bigint(before).alias("onpremises_usd"), bigint(cloud).alias("cloud_usd"),
                bigint(F.lit(before) - cloud).alias("saving_usd"),
            )
        )
    detail = costed.select(*group_by, "strategy", F.inline(F.array(*lines)))
    summed = (
        detail.rollup(*group_by, "strategy", "ord", "line")
        .agg(
            F.grouping_id().alias("_level"),
            *[F.sum(c).alias(c) for c in ("onpremises_usd", "cloud_usd", "saving_usd")],
        )
        .where(F.col("_level").isin(0, 3))
        .select(
            *group_by, "strategy", F.coalesce("ord", F.lit(7)).alias("ord"),
            F.coalesce("line", F.lit("SUMA")).alias("line"),
            F.when(F.col("_level") == 0, "line").otherwise("sum").alias("kind"),
            "onpremises_usd", "cloud_usd", "saving_usd",
        )
    )
    shown = costed.select(
        *group_by, "strategy", F.lit(8).alias("ord"), F.lit("TOTAL").alias("line"),
        F.lit("shown").alias("kind"),
        F.col("onpremises_annual_cost_usd").alias("onpremises_usd"),
        (F.col("cloud_annual_cost_usd") + fv.RESIDUAL_INCIDENT_COST).alias("cloud_usd"),
        F.col("annual_savings_usd").alias("saving_usd"),
    )
    return summed.unionByName(shown)


def services_by_layer(decided: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Services per architecture layer; a group has at most 16 services."""
    spark = decided.sparkSession
    layered = (
        advisor.services(decided, group_by)
        .join(dim.service_categories(spark), "service", "left")
        .join(dim.category_layers(spark), "category", "left")
        .withColumn("layer", F.coalesce("layer", F.lit(fv.LAYER_OTHERWISE)))
    )
    return layered.groupBy(*group_by, "strategy", "layer").agg(
        F.count(F.lit(1)).alias("services"),
        comma_text(F.array_sort(F.collect_list("service"))).alias("service_names"),
    )


def framework_scores(at_risk: DataFrame) -> DataFrame:
    """The first non-zero of readiness, exposure and coverage."""
    zero = F.lit(0)
    shown = F.coalesce(
        F.nullif(F.col("readiness"), zero), F.nullif(F.col("exposure"), zero), F.col("coverage")
    )
    return at_risk.withColumn("score", shown).drop("readiness", "exposure", "coverage")


def alerts(scored: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Alert flags of the sanctions and laundering scores."""
    return scored.select(
        *group_by,
        (F.col("ofac_sanctions_score") > 0).alias("ofac_alert"),
        (F.col("aml_risk_score") > 0).alias("aml_alert"),
    )


def batch_profile(payments: DataFrame) -> DataFrame:
    """What a batch is made of.

    Payments are counted per id first, null ids forming one group, so no window
    gathers the rows of an id; every other figure rides along as a sum.
    """
    return profile_of(per_id(payments))


def per_id(payments: DataFrame) -> DataFrame:
    """The counts behind H15 by payment id."""
    measures = {
        "n": "true",
        "sanctioned": member("country_code", fv.PROFILE_SANCTIONED_COUNTRIES),
        "near_limit": "_amount >= 9000 AND _amount < 10000",
        "negative": "_amount < 0",
        "legacy": "source_system = 'LEGACY_COBOL'",
    }
    return (
        payments.withColumn("_number", F.expr(parse_number("amount")))
        .withColumn("_amount", F.expr(nan_to_null("_number")))
        .groupBy("payment_id")
        .agg(*[F.expr(f"count_if({when}) AS {name}") for name, when in measures.items()])
    )


def profile_of(per_id: DataFrame) -> DataFrame:
    """H15 from counts by payment id, one row per id."""
    n = F.col("n")

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).alias(name)

    return per_id.agg(
        total(n, "total_records"),
        total(F.when(n > 1, n), "duplicate_records"),
        total(F.col("sanctioned"), "sanctioned_records"),
        total(F.col("near_limit"), "near_limit_records"),
        total(F.col("negative"), "negative_records"),
        total(F.when(F.col("payment_id").isNull(), n), "null_id_records"),
        total(F.col("legacy"), "legacy_records"),
    )


def value_counts(payments: DataFrame, column: str) -> DataFrame:
    """Counts per value, nulls included, most frequent first."""
    return (
        payments.groupBy(column)
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.desc("records"), F.col(column).asc_nulls_last())
    )


def key_figures(costed: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """The ten key figures as rows; the findings figure is the real count."""
    values = (
        "upper(strategy)", "effort_weeks", "total_investment_usd", "annual_savings_usd",
        "payback_months", "roi_3_years_pct", "cumulative_savings_3y_usd", "findings",
        "regulatory_risk_score", "data_quality_score",
    )
    rows = [
        f"{i}, {literal(name)}, CAST({value} AS STRING)"
        for i, (name, value) in enumerate(zip(fv.KPI_NAMES, values), 1)
    ]
    return costed.selectExpr(
        *group_by, f"stack({len(rows)}, {', '.join(rows)}) AS (ord, kpi, value)"
    )

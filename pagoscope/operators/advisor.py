"""Modernisation advice (G1-G11) on a table with one row per system.

Every operator is a projection on the score rows or a broadcast lookup by
strategy; the score rows are as many as there are systems.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pagoscope import fixed_values as fv
from pagoscope.functions import half_even, half_even_int
from pagoscope.operators import dimensions as dim
from pagoscope.operators import quality, scores
from pagoscope.operators import totals as tt
from pagoscope.operators.quality import holds


def assemble(
    payments: DataFrame, group_by: Sequence[str] = (), posture=None, as_of=None
) -> DataFrame:
    """G1: quality, posture and regulatory scores with the findings count."""
    totals = tt.run_totals(payments, group_by, as_of=as_of)
    scored = scores.regulatory_scores(quality.readiness(totals, posture))
    return with_defaults(
        scored.withColumn("findings", F.expr(tt.total_findings()))
    ).select(
        *group_by, *fv.SCORE_DEFAULTS, "ofac_sanctions_score", "aml_risk_score",
        "dora_resilience_score", "findings",
    )


def with_defaults(score_rows: DataFrame) -> DataFrame:
    """Missing or NULL scores take the stated defaults."""
    present = set(score_rows.columns)
    return score_rows.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in present else F.lit(value)
            for name, value in fv.SCORE_DEFAULTS.items()
        }
    )


def complexity() -> str:
    """Migration complexity, 0..100, as SQL text."""
    return half_even_int(
        "(1 - cloud_readiness_score / 100) * 40"
        " + (1 - data_quality_score / 100) * 25"
        " + (regulatory_risk_score / 100) * 20"
        " + least(findings / 200, 1D) * 15"
    )


def chosen_strategy() -> str:
    """The first strategy whose conditions hold, as SQL text."""
    return """
        CASE WHEN cloud_readiness_score >= 65 AND data_quality_score >= 85
                  AND regulatory_risk_score <= 30 THEN 'rehost'
             WHEN cloud_readiness_score >= 45 AND data_quality_score >= 70
                  AND regulatory_risk_score <= 55 THEN 'replatform'
             WHEN cloud_readiness_score >= 30 AND findings <= 80 THEN 'refactor'
             WHEN regulatory_risk_score >= 70 OR findings >= 150 THEN 'rebuild'
             ELSE 'hybrid' END"""


def decide(score_rows: DataFrame) -> DataFrame:
    """Complexity, strategy, effort and risk level on each row."""
    plan = dim.strategies(score_rows.sparkSession).select(
        "strategy", "effort_weeks", "risk_level"
    )
    return score_rows.withColumns(
        {
            "migration_complexity_score": F.expr(complexity()),
            "strategy": F.expr(chosen_strategy()),
        }
    ).join(F.broadcast(plan), "strategy")


def cost_table(spark) -> DataFrame:
    """The cost model of every strategy (five rows)."""

    def rounded(value: Column) -> Column:
        return (half_even(value / F.lit(1000)) * 1000).cast("bigint")

    effort = (
        F.col("effort_weeks") * fv.HOURS_PER_WEEK * F.col("share") * F.col("usd_per_hour")
    )
    # one partition: 25 constant rows need no exchange to be grouped
    labour = (
        dim.role_shares(spark)
        .coalesce(1)
        .join(dim.role_rates(spark), "role")
        .join(dim.strategies(spark), "strategy")
        .groupBy("strategy", "cloud_monthly")
        .agg(F.sum(effort).alias("_labour"))
    )
    saving, total = F.col("annual_savings_usd"), F.col("total_investment_usd")
    net = saving * 3 - total
    return (
        labour.withColumn("implementation_cost_usd", rounded(F.col("_labour")))
        .withColumn(
            "contingency_usd",
            rounded(F.col("implementation_cost_usd") * F.lit(fv.CONTINGENCY_SHARE)),
        )
        .select(
            "strategy",
            "implementation_cost_usd",
            "contingency_usd",
            (F.col("implementation_cost_usd") + F.col("contingency_usd"))
            .alias("total_investment_usd"),
            F.col("cloud_monthly").cast("bigint").alias("cloud_monthly_cost_usd"),
            (F.col("cloud_monthly") * 12).cast("bigint").alias("cloud_annual_cost_usd"),
            F.lit(fv.ON_PREMISES_ANNUAL).cast("bigint").alias("onpremises_annual_cost_usd"),
        )
        .withColumn(
            "annual_savings_usd",
            F.col("onpremises_annual_cost_usd") - F.col("cloud_annual_cost_usd"),
        )
        .withColumns(
            {
                "payback_months": F.when(
                    saving > 0,
                    F.expr(half_even_int("total_investment_usd / (annual_savings_usd / 12)")),
                ).otherwise(fv.PAYBACK_NEVER),
                "roi_3_years_pct": half_even(F.try_divide(net, total) * 100).cast("int"),
                "cumulative_savings_3y_usd": net,
            }
        )
    )


def with_costs(decided: DataFrame) -> DataFrame:
    """Cost columns on each decided row."""
    return decided.join(F.broadcast(cost_table(decided.sparkSession)), "strategy")


def with_risk_class(score_rows: DataFrame) -> DataFrame:
    """Composite regulatory risk with level, label, outcome and fine range."""
    composite = half_even_int(
        "regulatory_risk_score * 0.30D + (100 - pci_readiness_score) * 0.25D"
        " + (100 - sox_traceability_score) * 0.15D + pii_exposure_score * 0.20D"
        " + (100 - encryption_coverage_score) * 0.10D"
    )
    names = ("regulatory_risk_level", "risk_label", "audit_outcome", "fine_range")

    def banded(position: int) -> Column:
        *upper, last = fv.RISK_CLASSES
        chosen = reduce(
            lambda c, band: c.when(F.col("composite_score") >= band[1], band[position]),
            upper, F,
        )
        return chosen.otherwise(last[position])

    return score_rows.withColumn("composite_score", F.expr(composite)).withColumns(
        {name: banded(position) for name, position in zip(names, (0, 2, 3, 4))}
    )


def frameworks_at_risk(score_rows: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Up to four frameworks per row whose score misses its threshold."""
    rows = []
    for framework, column, comparison, threshold, kind, gap in fv.FRAMEWORK_GAPS:
        value = F.col(column).cast("int")
        kinds = [
            (value if kind == k else F.lit(None).cast("int")).alias(k)
            for k in ("readiness", "exposure", "coverage")
        ]
        entry = F.struct(F.lit(framework).alias("framework"), *kinds, F.lit(gap).alias("gap"))
        rows.append(F.when(holds(value, comparison, threshold), entry))
    return (
        score_rows.select(*group_by, F.explode(F.array(*rows)).alias("_r"))
        .where(F.col("_r").isNotNull())
        .select(*group_by, "_r.*")
    )


def complexity_by_dimension(classed: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """HIGH or MEDIUM per migration dimension."""

    def high_if(condition: Column) -> Column:
        return F.when(condition, "HIGH").otherwise("MEDIUM")

    levels = {
        "application": high_if(F.col("cloud_readiness_score") < 40),
        "data": high_if(F.col("data_quality_score") < 70),
        "security": F.lit("HIGH"),
        "compliance": high_if(F.col("regulatory_risk_level") == "HIGH"),
        "operational": F.lit("MEDIUM"),
    }
    rows = [
        F.struct(F.lit(name).alias("dimension"), level.alias("complexity"))
        for name, level in levels.items()
    ]
    return classed.select(*group_by, F.inline(F.array(*rows)))


def alternatives(decided: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """The strategies not chosen, each with its reason."""
    rows = [
        F.struct(F.lit(s[0]).alias("alternative"), F.lit(s[4]).alias("reason_rejected"))
        for s in fv.STRATEGIES
    ]
    return decided.select(*group_by, "strategy", F.inline(F.array(*rows))).where(
        F.col("alternative") != F.col("strategy")
    )


def _lookup(decided: DataFrame, table: DataFrame, group_by: Sequence[str]) -> DataFrame:
    return decided.select(*group_by, "strategy").join(F.broadcast(table), "strategy")


def phases(decided: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Roadmap phases of the chosen strategy; ``actions`` is one text."""
    return _lookup(decided, dim.phases(decided.sparkSession), group_by)


def services(decided: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Required services."""
    return _lookup(decided, dim.services(decided.sparkSession), group_by)


def team(decided: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Team roles."""
    return _lookup(decided, dim.teams(decided.sparkSession), group_by)


def risks(decided: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Project risks."""
    return _lookup(decided, dim.risks(decided.sparkSession), group_by)


def milestones(decided: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Project milestones."""
    return _lookup(decided, dim.milestones(decided.sparkSession), group_by)


def duration_months(weeks: Column) -> Column:
    """Weeks to months, one digit."""
    return half_even(weeks / F.lit(fv.WEEKS_PER_MONTH), 1)


def benefit_rollup(costed: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Yearly benefits and what is left after the cloud cost.

    The benefits do not add up to the on-premises base of the cost model; both
    figures are kept, under separate names.
    """
    total = F.lit(sum(usd for _, usd in fv.BENEFITS)).cast("bigint")
    return costed.select(
        *group_by,
        "strategy",
        *[F.lit(usd).cast("bigint").alias(f"{name}_usd") for name, usd in fv.BENEFITS],
        total.alias("total_annual_benefit_usd"),
        "cloud_annual_cost_usd",
        (total - F.col("cloud_annual_cost_usd")).alias("net_annual_savings_usd"),
        F.col("annual_savings_usd").alias("model_annual_savings_usd"),
    )
